"""Versions under keys, soft deletes and expiry, over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of the rows of each key the one that is largest by ``order``; rows without a key stay.

    The largest is an aggregate, so that a key with very many versions is
    brought down to one row for each task before anything is shuffled.
    """
    names = rows.columns
    row = F.struct(*[F.col(c) for c in names])
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*").select(*names).unionByName(rows.where(F.col(key).isNull()))


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose key isn't among the deleted."""
    return rows.join(deleted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*rows.columns)


def alive(rows: DataFrame, start: str, ttl_minutes: Column, now: Column) -> DataFrame:
    """The rows whose time to live, counted from ``start``, ends after ``now``; without one they stay."""
    ends = F.timestamp_seconds(F.unix_timestamp(start) + ttl_minutes.cast("long") * 60)
    late = F.col(start).cast("timestamp") - F.date_trunc("second", F.col(start).cast("timestamp"))
    return rows.where(F.coalesce(ends + late > now, F.lit(True)))


def not_expired(records: DataFrame, now: Column | None = None) -> DataFrame:
    """The records whose ``date_expires`` hasn't come."""
    return records.where(F.coalesce(F.col("date_expires") > (F.current_timestamp() if now is None else now), F.lit(True)))
