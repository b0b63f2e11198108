"""Set operators: membership, and what becomes of scores, counts and hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .results import COLUMNS, renamed, result


def or_(*sets: DataFrame) -> DataFrame:
    """Union; what is in several has the sums of scores and counts and all hits.  One shuffle for any number of sets."""
    both = reduce(DataFrame.unionByName, sets)
    return both.groupBy("rec_id").agg(
        F.sum("score").alias("score"), F.sum("hit_count").alias("hit_count"), F.sum("aux_count").alias("aux_count"), F.flatten(F.collect_list("hits")).alias("hits")
    )


def and_(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intersection, with sums."""
    return _added(left.join(renamed(right, "r"), "rec_id"))


def _added(df: DataFrame) -> DataFrame:
    return df.select("rec_id", *[(F.col(c) + F.col(f"r_{c}")).alias(c) for c in COLUMNS[1:4]], F.concat("hits", "r_hits").alias("hits"))


def andnot(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left set without the right."""
    return left.join(right.select("rec_id"), "rec_id", "left_anti")


def notand(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right set without the left."""
    return andnot(right, left)


def xor(left: DataFrame, right: DataFrame) -> DataFrame:
    """What is in one of the two."""
    both = left.join(renamed(right, "r").withColumn("r", F.lit(1)), "rec_id", "full_outer")
    one = both.where(F.col("score").isNull() | F.col("r").isNull())
    return one.select("rec_id", *[F.coalesce(c, f"r_{c}").alias(c) for c in COLUMNS[1:]])


def not_(records: DataFrame, found: DataFrame) -> DataFrame:
    """All other records, with the score sqrt(N - n) / N.

    N and n are aggregates of one row each, joined with every row of the result.
    """
    counts = records.agg(F.count(F.lit(1)).alias("_all")).crossJoin(found.agg(F.count(F.lit(1)).alias("_n")))
    rest = records.select("rec_id").join(found.select("rec_id"), "rec_id", "left_anti").crossJoin(F.broadcast(counts))
    return result(rest, score=F.sqrt(F.col("_all") - F.col("_n")) / F.col("_all"))


def xnor(records: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return not_(records, xor(left, right))


def nor(records: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return not_(records, or_(left, right))


def nand(records: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return not_(records, and_(left, right))


def maybe(left: DataFrame, right: DataFrame) -> DataFrame:
    """The intersection if there is any; else the larger set, on equal sizes that of the higher best score (then the left).

    One plan: the two sets meet once in a full outer join, whose rows tell which
    of the sets they belong to; a row of counts decides which of them stay.
    """
    both = left.withColumn("l", F.lit(1)).join(renamed(right, "r").withColumn("r", F.lit(1)), "rec_id", "full_outer")
    counts = both.agg(
        F.count(F.when(F.col("l") == 1, F.col("r"))).alias("_common"), F.count("l").alias("_left"), F.count("r").alias("_right"),
        F.max("score").alias("_lbest"), F.max("r_score").alias("_rbest"),
    )
    pick_left = (F.col("_left") > F.col("_right")) | ((F.col("_left") == F.col("_right")) & (F.coalesce("_lbest", F.lit(0.0)) >= F.coalesce("_rbest", F.lit(0.0))))
    rows = both.crossJoin(F.broadcast(counts))
    inner = (F.col("l") == 1) & (F.col("r") == 1)
    stay = F.when(F.col("_common") > 0, F.coalesce(inner, F.lit(False))).when(pick_left, F.col("l").isNotNull()).otherwise(F.col("r").isNotNull())

    def value(c: str) -> Column:
        both_ = F.concat("hits", "r_hits") if c == "hits" else F.col(c) + F.col(f"r_{c}")
        return F.when(F.col("_common") > 0, both_).when(pick_left, F.col(c)).otherwise(F.col(f"r_{c}")).alias(c)

    return rows.where(stay).select("rec_id", *[value(c) for c in COLUMNS[1:]])


def promote(left: DataFrame, right: DataFrame, sign: int = 1) -> DataFrame:
    """The right set; records that are in the left too gain its score, but no hits or counts."""
    extra = left.select("rec_id", F.col("score").alias("_extra"))
    return right.join(extra, "rec_id", "left").withColumn("score", F.col("score") + sign * F.coalesce("_extra", F.lit(0.0))).drop("_extra")


def demote(left: DataFrame, right: DataFrame) -> DataFrame:
    """As ``promote``, but they lose it."""
    return promote(left, right, -1)


def join_key(left: DataFrame, left_records: DataFrame, right: DataFrame, right_records: DataFrame) -> DataFrame:
    """JOIN across collections: records of the left whose key the right has too, with the sum of both scores.

    A key that several records of the right have adds the sum of their scores.
    """
    keys = right.join(right_records.select("rec_id", "key"), "rec_id").where("key is not null").groupBy("key").agg(F.sum("score").alias("_more"))
    own = left.join(left_records.select("rec_id", "key"), "rec_id")
    return own.join(keys, "key").select("rec_id", (F.col("score") + F.col("_more")).alias("score"), "hit_count", "aux_count", "hits")


def merged(rows: DataFrame, best: bool = False) -> DataFrame:
    """Rows that repeat a record as one: scores and counts summed, or where ``best`` the largest score."""
    return rows.groupBy("rec_id").agg(
        (F.max("score") if best else F.sum("score")).alias("score"), F.sum("hit_count").alias("hit_count"), F.max("aux_count").alias("aux_count"),
        F.flatten(F.collect_list("hits")).alias("hits"),
    )
