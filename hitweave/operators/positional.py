"""Proximity and order of hits.

The hits of a record stand in arrays, so a pair of operands takes one join by
record and the pairs of hits are formed within the row.  The gap of two hits is
what lies between them; hits that overlap have none and are not near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import HITS
from .results import renamed, result


def gap(x: Column, y: Column) -> Column:
    """Characters between two hits, negative where they overlap."""
    return F.when(x["start"] <= y["start"], y["start"] - x["end"]).otherwise(x["start"] - y["end"]) - 1


def pairs(left: str, right: str, test) -> Column:
    """The pairs (x, y) of two arrays of hits that stand the test."""
    return F.flatten(F.transform(left, lambda x: F.transform(F.filter(right, lambda y: test(x, y)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def near(
    left: DataFrame, right: DataFrame, distance: Column | int, order: str | None = None, far: bool = False, lengths: DataFrame | None = None
) -> DataFrame:
    """Records with hits of both within ``distance``; ``far``: at that distance or further.

    ``order``: ``before`` or ``after``, where the left's hit comes.  ``distance``
    may be a column over ``rec_len`` if ``lengths(rec_id, rec_len)`` is given.
    The score is that of the right operand; ``hit_count`` counts the pairs.
    """
    both = left.select("rec_id", "hits").join(renamed(right, "r"), "rec_id")
    if lengths is not None:
        both = both.join(lengths.select("rec_id", "rec_len"), "rec_id")
    limit = distance if isinstance(distance, Column) else F.lit(distance)
    both = both.withColumn("_limit", limit.cast("long"))

    def test(x: Column, y: Column) -> Column:
        g = gap(x, y)
        ok = (g >= F.col("_limit")) if far else (g >= 0) & (g <= F.col("_limit"))
        if order == "before":
            ok &= x["start"] < y["start"]
        elif order == "after":
            ok &= x["start"] > y["start"]
        return ok

    found = both.withColumn("_pairs", pairs("hits", "r_hits", test)).where(F.size("_pairs") > 0)
    hits = F.array_distinct(F.concat(F.transform("_pairs", lambda p: p["x"]), F.transform("_pairs", lambda p: p["y"])))
    return result(found.withColumn("_hits", hits), score=F.col("r_score"), hit_count=F.size("_pairs"), aux_count=2, hits=F.col("_hits").cast(HITS))


#: Distance where none is given.
NEAR = 50


def share_of_length(share: float) -> Column:
    """A share of the record's length, 2 at least."""
    return F.greatest(F.lit(2), F.floor(F.col("rec_len") * F.lit(share)))


def adj(left: DataFrame, right: DataFrame) -> DataFrame:
    return near(left, right, 3)


def follows(left: DataFrame, right: DataFrame) -> DataFrame:
    return near(left, right, 4, order="after")


def precedes(left: DataFrame, right: DataFrame) -> DataFrame:
    return near(left, right, 4, order="before")


def neighbor(left: DataFrame, right: DataFrame, lengths: DataFrame) -> DataFrame:
    return near(left, right, share_of_length(0.05), lengths=lengths)


def far(left: DataFrame, right: DataFrame, distance: int = NEAR) -> DataFrame:
    return near(left, right, distance, far=True)
