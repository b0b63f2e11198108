"""Relevance models over the set of one term.

``tf``: hits in the record, ``n``: records of the set, ``N``: all records, ``w``: the
term's weight, ``idf = 1 + ln(N / n)``.  What a model needs of the whole set is one
row of aggregates that is joined with each row; nothing is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import Collection

# Fixed values of the model af.
AF_K3, AF_SCALE = -993.0, 0.75
METHODS = ("none", "l2", "l1", "s2", "bm25", "max", "log", "bytes", "af")


def score(
    found: DataFrame, c: Collection, method: str = "l2", weight: float = 1.0, k1: float = 1.2, b: float = 0.75, a: float = 0.0, recency: float = 0.0, pivot: float = 0.0
) -> DataFrame:
    """The set with the scores of a model.

    ``b`` is 0 for results without length normalisation; ``a`` and ``recency`` with
    ``pivot`` (a year) are BM25's variants with a power of tf and with a decay by
    the record's age in years.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"no such model: {method}")
    if method == "none":
        return found.withColumn("score", F.lit(0.0))
    tf, w = F.col("hit_count").cast("double"), F.lit(float(weight))
    rows = found
    if method == "bytes" or method == "bm25" and (b or recency > 0 and pivot > 0):
        rows = rows.join(c.described().select("rec_id", "rec_len", "date"), "rec_id")
    if method not in ("l2", "l1", "max"):  # those divide idf by itself
        rows = rows.crossJoin(F.broadcast(c.statistics().crossJoin(found.agg(F.count(F.lit(1)).alias("_n")))))
    big, n = F.col("n_records").cast("double"), F.col("_n").cast("double")
    idf = 1 + F.log(big / n)
    ti = tf * idf
    if method in ("l2", "l1", "max", "af"):
        total = {"l2": F.sqrt(F.sum(tf * tf)), "l1": F.sum(tf), "max": F.max(tf), "af": F.sum(F.log1p(tf))}[method]
        rows = rows.crossJoin(F.broadcast(found.agg(total.alias("_total"))))
    whole = F.col("_total")
    if method == "l2":
        value = tf * w / whole
    elif method == "l1":
        value = tf * w / F.abs(whole * w) if weight else F.lit(0.0)
    elif method == "s2":
        value = 2 * tf / (tf + 1) * idf * w
    elif method == "bm25":
        rate = F.log(1 + (big - n + 0.5) / (n + 0.5))
        norm = F.lit(k1) * (1 - b + b * F.col("rec_len") / F.col("avg_len")) if b else F.lit(float(k1))
        value = w * rate * (F.pow(tf, F.lit(a)) / (F.pow(tf, F.lit(a)) + norm) if a > 0 else tf * (k1 + 1) / (tf + norm))
        if recency > 0 and pivot > 0:
            age = F.least(F.greatest(F.lit(pivot) - F.year("date"), F.lit(0.0)), F.lit(40.0))
            value = value * F.coalesce(F.pow(F.lit(1 + recency), -age / 10), F.lit(1.0))
    elif method == "max":
        value = (0.4 + 0.6 * tf / whole) * w
    elif method == "log":
        value = (1 + F.log(ti)) * w
    elif method == "bytes":
        value = tf * w * F.log(big / n) / (1 + F.log(F.greatest(F.col("rec_len"), F.lit(1)).cast("double")))
    else:  # af: by the term's weight in the collection, and that of the query's term
        rate = F.log((big - idf + 0.5) / (idf + 0.5)) * F.log1p(w)
        query = (AF_K3 + 1) * w / (AF_K3 + w)
        value = ti * w / rate / F.when(F.abs(whole) > 0, F.abs(whole * AF_SCALE * rate * query)).otherwise(1.0)
    return rows.select("rec_id", value.cast("double").alias("score"), "hit_count", "aux_count", "hits")


def _least_gap() -> Column:
    """The smallest gap of hits that follow each other, of different words where sources are told apart."""
    s = F.array_sort("hits")
    n = F.size(s)
    gaps = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)), lambda i: F.greatest(F.element_at(s, (i + 1).cast("int"))["start"] - F.element_at(s, i.cast("int"))["end"] - 1, F.lit(0)))
    return F.array_min(gaps)


def euclidean(found: DataFrame) -> DataFrame:
    """E1: records with several operands gain by how close their hits are: times ``1 + 3 / (1 + d / 8)``."""
    factor = F.when((F.col("aux_count") > 1) & _least_gap().isNotNull(), 1 + 3 / (1 + _least_gap() / 8)).otherwise(1.0)
    return found.withColumn("score", F.col("score") * factor)


def coverage(found: DataFrame) -> DataFrame:
    """E2: by the share of the operands that contributed and, weighted with it, by closeness."""
    most = F.broadcast(found.agg(F.max("aux_count").alias("_most")))
    share = F.col("aux_count") / F.col("_most")
    near = F.when((F.col("aux_count") > 1) & _least_gap().isNotNull(), 1 + 3 / (1 + _least_gap() / 8)).otherwise(1.0)
    return found.crossJoin(most).withColumn("score", F.col("score") * (0.5 + 0.5 * share) * (1 + (near - 1) * share)).drop("_most")


def scaled(found: DataFrame, low: float = 1.0, high: float = 100.0) -> DataFrame:
    """Adds ``scaled``: the score between the set's smallest and largest, as 1 to 100."""
    ends = F.broadcast(found.agg(F.min("score").alias("_min"), F.max("score").alias("_max")))
    span = F.col("_max") - F.col("_min")
    value = F.when(span > 0, F.lit(low) + (F.col("score") - F.col("_min")) * F.lit(high - low) / span).otherwise(F.lit(high))
    return found.crossJoin(ends).withColumn("scaled", value).drop("_min", "_max")


def hybrid(found: DataFrame, weight: float = 1.0) -> DataFrame:
    """Vector scores brought to 0.4 .. 1.0 times the weight, so that they add to those of words."""
    ends = F.broadcast(found.agg(F.min("score").alias("_min"), F.max("score").alias("_max")))
    span = F.col("_max") - F.col("_min")
    value = F.when(span > 0, 0.4 + 0.6 * (F.col("score") - F.col("_min")) / span).otherwise(1.0) * F.lit(float(weight))
    return found.crossJoin(ends).withColumn("score", value).drop("_min", "_max")


def with_priority(found: DataFrame, c: Collection, factor: float) -> DataFrame:
    """Records with a priority gain ``factor / priority`` times the spread of the scores."""
    ends = F.broadcast(found.agg((F.max("score") - F.min("score")).alias("_spread")))
    rows = found.join(c.described().select("rec_id", "priority"), "rec_id").crossJoin(ends)
    more = F.when(F.col("priority") > 0, F.lit(float(factor)) * F.col("_spread") / F.col("priority")).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + F.coalesce(more, F.lit(0.0))).drop("priority", "_spread")
