"""Orders of a result set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..collection import Collection
from ..storage import written

#: What the orders need of a record.
_META = {"date": "date", "reverse_date": "date", "key": "key", "category": "category", "newsrank": "date", "adjscore": "category"}


# Fixed values of the recency weight: what an age in whole days up to the first number adds,
# what an age in hours up to the first number multiplies by, and the weights of today and of dates to come.
NEWS_DAYS = ((1, 5.0), (2, 4.0), (3, 1.75), (7, 0.75), (14, 0.55), (24, 0.43), (60, 0.32), (100, 0.21), (300, 0.10))
NEWS_HOURS = ((2, 12.0), (3, 9.0), (4, 6.2), (8, 4.6), (12, 3.2), (16, 2.6), (23, 2.2))
NEWS_TODAY, NEWS_OLDER, NEWS_TOMORROW, NEWS_LATER = 10.0, 1.0, -7.0, 6.0
#: Dates up to so many hours ahead, which a time zone may explain, count as so many hours old.
NEWS_AHEAD, NEWS_AHEAD_AS = 18, 2


def news_weight(hours: Column) -> Column:
    """How an age in hours weighs: fresh records by far the most, dates to come against them; null: as nothing known, 1."""
    age = F.when((hours < 0) & (hours > -NEWS_AHEAD), NEWS_AHEAD_AS).otherwise(hours.cast("long"))
    days = (age / 24).cast("long")
    base = F.when(days == -1, NEWS_TOMORROW).when(days < 0, days * NEWS_LATER).when(days == 0, NEWS_TODAY).otherwise(NEWS_OLDER)
    for most, more in NEWS_DAYS:
        base = base + F.when(days <= most, more).otherwise(0.0)
    times = F.lit(1.0)
    for most, factor in reversed(NEWS_HOURS):
        times = F.when(age <= most, factor).otherwise(times)
    return F.coalesce(base * times, F.lit(1.0))


def sort(found: DataFrame, c: Collection, by: str = "score", now: Column | None = None, key: Callable[[DataFrame], list[Column]] | None = None) -> DataFrame:
    """The set in an order; every order ends with the record, so that it is total.

    score, hits, reverse_hits, auxcount, date, reverse_date, key, index,
    newsrank (score by recency at ``now``), category, adjscore (score times one
    plus a tenth of the category), function (``key`` gives the columns).
    """
    rows, order = _ordered(found, c, by, now, key)
    return rows.orderBy(*order).drop("_meta")


def places(found: DataFrame, c: Collection, by: str = "score", now: Column | None = None, key: Callable[[DataFrame], list[Column]] | None = None) -> DataFrame:
    """The set with each record's ``place`` in the whole order, from 1; see ``sort``."""
    rows, order = _ordered(found, c, by, now, key)
    return numbered(rows, order, "place").drop("_meta")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows numbered from 1 in a total order: sorted by ranges, and each range moved on by the sizes of those before."""
    # written, so that a range's rows and its size are of the same ranges
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "order")
    sizes = placed.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def _ordered(found, c, by, now, key):
    """The rows with what the order needs, and the order's columns."""
    by = by.lower()
    rows = found
    if by in _META:
        rows = rows.join(c.described().select("rec_id", F.col(_META[by]).alias("_meta")), "rec_id")
    score, rec = F.desc("score"), F.desc("rec_id")
    if by == "newsrank":
        hours = (((now if now is not None else F.current_timestamp()).cast("long") - F.col("_meta").cast("long")) / 3600).cast("long")
        rows = rows.withColumn("score", F.col("score") * news_weight(hours))
    if by == "adjscore":
        rows = rows.withColumn("score", F.col("score") * (1 + F.coalesce("_meta", F.lit(0)) / 10))
    orders = {
        "score": [score, rec], "hits": [F.desc("hit_count"), score, rec], "reverse_hits": [F.asc("hit_count"), score, rec],
        "auxcount": [F.desc("aux_count"), score, rec], "date": [F.col("_meta").desc_nulls_last(), score, rec],
        "reverse_date": [F.col("_meta").asc_nulls_last(), score, rec], "key": [F.col("_meta").desc_nulls_last(), rec], "index": [F.asc("rec_id")],
        "newsrank": [score, rec], "adjscore": [score, rec], "category": [F.col("_meta").desc_nulls_last(), score, rec],
    } | ({"function": [*key(rows), rec]} if key else {})
    if by not in orders:
        raise ValueError(f"no such order: {by}")
    return rows, orders[by]


def external(found: DataFrame, ranks: DataFrame) -> DataFrame:
    """By an external ``(rec_id, position)``; records without a position come last."""
    return found.join(ranks.select("rec_id", "position"), "rec_id", "left").orderBy(F.col("position").asc_nulls_last(), F.desc("score"), F.desc("rec_id")).drop("position")


def magnetised(found: DataFrame, c: Collection, band: float = 0.1) -> DataFrame:
    """The set with records of one category drawn together within a score band.

    Scores fall into bands of ``band`` times the best score; within a band the
    categories follow each other by their best record.  ``rank`` gives the order.
    """
    rows = found.join(c.described().select("rec_id", "category"), "rec_id")
    peak = F.broadcast(found.agg(F.max("score").alias("_peak")))
    rows = written(rows.crossJoin(peak).withColumn("_band", F.floor((F.col("_peak") - F.col("score")) / F.greatest(F.col("_peak") * band, F.lit(1e-12)))), "bands")
    # the best of a category in a band is combined before its shuffle: few rows, however many a band holds
    leads = rows.groupBy("_band", "category").agg(F.max("score").alias("_lead"))
    rows = rows.join(leads.withColumnRenamed("category", "_category").withColumnRenamed("_band", "_own"), (F.col("_band") == F.col("_own")) & F.col("category").eqNullSafe(F.col("_category")))
    order = [F.asc("_band"), F.desc("_lead"), F.col("category").asc_nulls_last(), F.desc("score"), F.desc("rec_id")]
    return numbered(rows.drop("_own", "_category"), order, "rank").drop("_peak", "_band", "_lead")


def neighbours(c: Collection) -> DataFrame:
    """``(rec_id, key, prev_key, next_key)``: each key with those beside it, within ranges of keys.

    The keys are sorted by ranges; the ends of a range meet through the first
    and last key of each, which are as few as there are ranges.
    """
    keys = c.described().where("key is not null").select("rec_id", "key")
    # written, so that both uses see the same ranges
    placed = written(keys.repartitionByRange("key").withColumn("_part", F.spark_partition_id()), "keys")
    order = Window.partitionBy("_part").orderBy("key", "rec_id")
    rows = placed.withColumn("_prev", F.lag("key").over(order)).withColumn("_next", F.lead("key").over(order))
    ends = placed.groupBy("_part").agg(F.min("key").alias("_first"), F.max("key").alias("_last"))
    over = Window.orderBy("_part")
    ends = ends.withColumn("_before", F.lag("_last").over(over)).withColumn("_after", F.lead("_first").over(over)).select("_part", "_before", "_after")
    return rows.join(F.broadcast(ends), "_part").select("rec_id", "key", F.coalesce("_prev", "_before").alias("prev_key"), F.coalesce("_next", "_after").alias("next_key"))
