"""Vector fields: nearest neighbours by cosine, and their scores beside those of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .results import result


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest(vectors: DataFrame, query: Sequence[float] | DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` records of ``vectors(rec_id, vector)`` of largest cosine to a query, exactly; a query may be a frame of one row ``(query)``."""
    if isinstance(query, DataFrame):
        rows = vectors.crossJoin(F.broadcast(query.select("query").limit(1)))
    else:
        rows = vectors.withColumn("query", F.array(*[F.lit(float(x)) for x in query]))
    rows = rows.withColumn("_score", cosine(F.col("vector"), F.col("query")))
    best = rows.orderBy(F.desc("_score"), "rec_id").limit(k)
    return result(best, score=F.col("_score"))
