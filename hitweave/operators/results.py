"""What all operators share about result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import HITS

COLUMNS = ("rec_id", "score", "hit_count", "aux_count", "hits")


def result(df: DataFrame, score: Column | float = 0.0, hit_count: Column | None = None, aux_count: Column | int = 1, hits: Column | None = None) -> DataFrame:
    """The rows of ``df(rec_id, ..)`` as a result set."""
    own = hits if hits is not None else F.array()
    return df.select(
        "rec_id",
        (score if isinstance(score, Column) else F.lit(score)).cast("double").alias("score"),
        (hit_count if hit_count is not None else F.lit(1)).cast("long").alias("hit_count"),
        (aux_count if isinstance(aux_count, Column) else F.lit(aux_count)).cast("long").alias("aux_count"),
        own.cast(HITS).alias("hits"),
    )


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def no_hits(n: str = "hits") -> Column:
    return F.array().cast(HITS).alias(n)


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    """The result set with its columns but the id under a prefix."""
    return df.select("rec_id", *[F.col(c).alias(f"{prefix}_{c}") for c in COLUMNS[1:]])


def save(found: DataFrame, path: str) -> None:
    """A result set as a table, to be loaded again."""
    found.select(*COLUMNS).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"rec_id long, score double, hit_count long, aux_count long, hits {HITS}").parquet(path)
