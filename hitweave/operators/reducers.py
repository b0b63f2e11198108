"""Filters on what a result set has counted, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions.text import matches_glob
from .results import COLUMNS

_RELATIONS = {
    "=": lambda a, b: a == b, "==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b,
}


def relation(name: str):
    return _RELATIONS[name]


def reduce(found: DataFrame, n: int = 0) -> DataFrame:
    """REDUCE:n: records to which ``n`` operands or more contributed; 0: as many as for the best record."""
    if n > 0:
        return found.where(F.col("aux_count") >= n)
    most = F.broadcast(found.agg(F.max("aux_count").alias("_most")))
    return found.crossJoin(most).where(F.col("aux_count") >= F.col("_most")).drop("_most")


def focus(found: DataFrame, n: int = 0) -> DataFrame:
    """FOCUS:n: as REDUCE, but where no record has ``n`` it takes the best tier there is; it empties no set."""
    if n <= 0:
        return reduce(found, 0)
    most = F.broadcast(found.agg(F.max("aux_count").alias("_most")))
    return found.crossJoin(most).where(F.col("aux_count") >= F.least(F.col("_most"), F.lit(n))).drop("_most")


def hit_count(found: DataFrame, n: int, how: str | None = None) -> DataFrame:
    """HITCOUNT: by a relation; without one ``n`` hits or more, or for a negative ``n`` that many at most."""
    if how is None:
        how, n = (">=", n) if n >= 0 else ("<=", -n)
    return found.where(relation(how)(F.col("hit_count"), n))


def trim(found: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """TRIM:n: the first ``n`` of the order, by default by score."""
    return found.orderBy(*(order or [F.desc("score"), F.desc("rec_id")])).limit(max(0, n))


def boost(found: DataFrame, weight: float) -> DataFrame:
    """BOOST:w."""
    return found.withColumn("score", F.col("score") * F.lit(float(weight)))


def with_meta(found: DataFrame, c: Collection, column: str, pattern: str) -> DataFrame:
    """WITHKEY, FILE, EXTENSION, DOCTYPE: records whose metadata matches a glob."""
    return found.join(c.described().where(matches_glob(F.col(column), pattern)).select("rec_id"), "rec_id", "left_semi")


def in_dates(found: DataFrame, c: Collection, low: str | None, high: str | None) -> DataFrame:
    """WITHIN:daterange: records dated from ``low`` to before ``high`` (timestamps; null: open)."""
    rows = c.described().where(F.col("date").isNotNull())
    if low is not None:
        rows = rows.where(F.col("date") >= F.lit(low).cast("timestamp"))
    if high is not None:
        rows = rows.where(F.col("date") < F.lit(high).cast("timestamp"))
    return found.join(rows.select("rec_id"), "rec_id", "left_semi")


def score_above(found: DataFrame, least: float) -> DataFrame:
    """Drops what scores less."""
    return found.where(F.col("score") >= F.lit(float(least)))


def scaled_above(found: DataFrame, least: float) -> DataFrame:
    """Drops what scores less on the scale from 1 to 100."""
    from .scoring import scaled

    return scaled(found).where(F.col("scaled") >= F.lit(float(least))).select(*COLUMNS)


def without_terms(found: DataFrame, other: DataFrame) -> DataFrame:
    """Drops the records of another set."""
    return found.join(other.select("rec_id"), "rec_id", "left_anti")
