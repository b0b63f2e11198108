"""Structured Streaming into a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.reader import _DOC, _read, _tables
from .store import Store


def files(spark: SparkSession, path: str, format: str = "AUTODETECT", glob: str | None = None, per_batch: int = 1000, **options) -> DataFrame:
    """A stream of parsed records from the files that come to a folder, each read once."""
    from ..sources.formats import FORMATS

    make = FORMATS[format.upper()] if isinstance(format, str) else format
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true")
    if glob:
        source = source.option("pathGlobFilter", glob)
    return source.load(path).select("path", "content").mapInArrow(lambda b: _read(b, make, options), _DOC)


def ingest(stream: DataFrame, store: Store, checkpoint: str, tables: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch of a stream to the store under the batch's own number.

    ``tables`` turns a batch into records and extents; without it the stream is
    that of ``files``.
    """
    make = tables or _tables

    def batch(df: DataFrame, number: int) -> None:
        store.append(number, *make(df))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def activity(stream: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "1 day", value: Column | None = None) -> DataFrame:
    """How often each key came in each window of event time; what is later than ``late`` is left out, as the state is kept no longer."""
    grouped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *keys)
    total = [F.sum(value).alias("total")] if value is not None else []
    return grouped.agg(F.count(F.lit(1)).alias("n"), *total).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *[c for c in ("total",) if total])
