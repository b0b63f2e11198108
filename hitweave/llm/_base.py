"""What the operators share: words, schemas, written tables, components."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, stored, written

__all__ = ["WORD_BYTES", "components", "discard", "extended", "free", "meet", "small", "written"]

#: A key is hot if it has more rows than this, and more than one in ``SHARE`` of all: so there are at most ``SHARE`` such keys.
HOT, SHARE = 1_000, 10_000
#: Bytes of the files of a table that is broadcast, at most.
SMALL = 4 << 20

#: Lower-cases A-Z and turns what is in no word into spaces: ``text.translate(WORD_BYTES).split()``
#: gives the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
WORD_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


def extended(carried: DataFrame, skip: int, more: str) -> T.StructType:
    """The schema of ``carried`` without its first ``skip`` columns, followed by the columns that ``more`` declares."""
    return T.StructType(carried.schema.fields[skip:] + T._parse_datatype_string(more).fields)


def free(names: Iterable[str], taken: Iterable[str], suffix: str = "") -> list[str]:
    """An operator's own column names, each with ``suffix`` and as many underscores as keep it apart from those ``taken``.

    Column names are compared as Spark does by default, without regard to case.
    """
    used, out = {t.lower() for t in taken}, []
    for name in names:
        name += suffix
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def small(table: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast."""
    return stored(table) <= SMALL


def meet(rows: DataFrame, one: DataFrame, on: str | Sequence[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``one``, which has one row of bounded size for a key, in a way that no hot key lands in one task.

    The rows of hot keys (at most ``SHARE`` keys, found by a count that is combined
    before its shuffle) stay where they are and meet a broadcast of their rows of
    ``one``; all others go by a shuffled join.  ``rows`` is read again: a written
    table.  ``counts``: such a table of the keys' ``count``, where there is one.
    """
    on = [on] if isinstance(on, str) else list(on)
    counts = written(rows.groupBy(*on).count().where(F.col("count") > HOT), "counts") if counts is None else counts.where(F.col("count") > HOT)
    total = rows.count() if counts.limit(1).count() else 0
    keys = counts.where(F.col("count") > total // SHARE).select(*on)
    if not total or not keys.limit(1).count():
        return rows.join(one, on, how)
    keys = F.broadcast(keys)
    some = rows.join(keys, on, "left_semi").join(F.broadcast(one.join(keys, on, "left_semi")), on, how)
    return rows.join(keys, on, "left_anti").join(one, on, how).unionByName(some)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, undirected, loops ignored).

    Returns ``(node, root)`` for every node with an edge to another, root being the
    smallest node reachable.  Alternates large-star and small-star steps until the
    edge set is a forest of stars; each step aggregates before it shuffles and
    joins the minimum back, hubs by ``meet``.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _signature(now)
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("count")).withColumn("m", F.least("a", "m")), "least")
        large = meet(both, low.drop("count"), "a", counts=low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = (
            large.join(own, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = written(stars, "edges")
        sign = _signature(after)
        discard(now)
        discard(low)
        now = after
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = sign


def _signature(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and two sums of hashes."""
    row = edges.agg(
        F.count(F.lit(1)),
        F.sum((F.xxhash64("a", "b") % F.lit(1 << 40)).cast("decimal(38,0)")),
        F.sum((F.hash("b", "a")).cast("long")),
    ).first()
    return tuple(row)
