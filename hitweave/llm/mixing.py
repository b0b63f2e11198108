"""Mixing sources to target weights by Poisson replication.

A source that is to make up the share ``w`` of a mixture of a given size is
repeated ``w * size / (its own size)`` times on average.  Each document draws
how often it is repeated from the Poisson distribution with that mean, by
inverting it at a uniform number that a hash of the seed and the document's id
gives: the draw needs no state, is the same in every run, and documents of
equal ids are drawn alike.  A mean above ``PART`` is the sum of independent draws
of equal means up to it, each at a hash of its own.  The copies are then shuffled over all partitions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import free, written

#: No source is repeated more often than this on average; a caller may bound it.
MOST = math.inf
#: The largest mean of a single draw.
PART = 16.0
#: Terms of the distribution; beyond them is less than 2**-53 of it at a mean of PART.
TERMS = 100
#: Draws of one document, and copies, that are listed at a time.
DRAWS, COPIES = 4096, 65536


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts, of 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(rate: Column) -> Column:
    """The distribution function at 0, 1, .. of the Poisson distribution with mean ``rate``, as far as it is below 1."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), F.concat(a["all"], F.array(a["c"] + p)).alias("all"))

    return F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["all"]), lambda c: c < 1.0)


def repetitions(ident: Column, parts: Column, table: Column, seed: int) -> Column:
    """How often a document is repeated: the sum of ``parts`` draws from ``table``."""

    def drawn(u: Column) -> Column:
        return F.size(F.filter(table, lambda c: c <= u)).cast("long")

    def some(first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda a, k: a + drawn(uniform(F.lit(f"{seed}/part"), ident, k.cast("string"))))

    blocks = F.sequence(F.lit(0).cast("long"), F.floor((parts - 1) / DRAWS))
    many = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + some(b * DRAWS + 1, F.least((b + 1) * DRAWS, parts)))
    return F.when(parts == 1, drawn(uniform(F.lit(str(seed)), ident))).otherwise(many)


def rates(
    docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", text_col: str = "text", alpha: float = 0.5, size: float | None = None, most: float = MOST
) -> DataFrame:
    """``(source, bytes, weight, rate)`` of each source: its size, its share of the mixture, its mean repetitions.

    ``weights``: of sources by name; sources that aren't named get none.  Without
    it a source's weight is its size to the power ``alpha``.  ``size``: bytes of
    the mixture, those of ``docs`` if not given.  Sources without any text have
    the rate 1; a null source is one of its own.
    """
    own = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("bytes"))
    if weights is None:
        raw = F.pow(F.col("bytes").cast("double"), F.lit(alpha))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        raw = F.coalesce(F.element_at(named, F.col("source")), F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    table = written(own.withColumn("raw", raw), "sources")
    total = table.agg(F.sum("raw"), F.sum("bytes")).first()
    whole, size = total[0] or 1.0, float(total[1] or 0) if size is None else float(size)
    share = F.col("raw") / F.lit(float(whole))
    rate = F.when(F.col("bytes") > 0, F.least(share * F.lit(size) / F.col("bytes"), F.lit(float(most)))).otherwise(1.0)
    return table.select("source", "bytes", share.alias("weight"), rate.alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    alpha: float = 0.5,
    size: float | None = None,
    most: float = MOST,
    suffix: str = "",
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy`` (from 1), ``rate`` and ``shuffle_key``, in a random order.

    The order within each partition is that of ``shuffle_key``, a hash of the
    seed, the id and the copy, by whose hash the rows are dealt to the
    partitions.  ``suffix`` ends the three names, which give way to columns of
    ``docs`` of their names by underscores.
    Null ids are drawn alike, like any that repeat; null texts have no bytes but
    are drawn as their source is.
    """
    names = docs.columns
    table = rates(docs, weights, source_col, text_col, alpha, size, most)
    # a row of a few numbers for each source: Spark broadcasts it if its file is small
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("long")
    table = written(
        table.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), parts.alias("_parts"), poisson_table(F.col("rate") / parts).alias("_table")), "rates"
    )
    # the rows' own columns travel in a struct, whatever their names
    rows = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ident"), F.col(source_col).cast("string").alias("own"))
    drawn = rows.join(table, F.col("own").eqNullSafe(F.col("_source")))
    counted = drawn.withColumn("n", repetitions(F.col("ident"), F.col("_parts"), F.col("_table"), seed)).where("n > 0")
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least((F.col("block") + 1) * COPIES, F.col("n")))))
    copies = copies.withColumn("copy", F.col("copy").cast("int"))
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}/copy"), F.col("ident"), F.col("copy").cast("string"))), 1, 16)
    out = copies.select("row", "ident", "copy", F.col("_rate").alias("rate"), key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "ident")
    own = ("copy", "rate", "shuffle_key")
    return out.select(*[F.col("row")[c].alias(c) for c in names], *[F.col(c).alias(n) for c, n in zip(own, free(own, names, suffix), strict=True)])
