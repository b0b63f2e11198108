"""Tables whose lines or cells are records: CSV, NDJSON, and JSON in a column.

These are read by Spark's own readers, which split large files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import extents, records
from ..functions import values as V
from ..functions.text import packed


def json_extents(df: DataFrame, rec_id: str, column: str, arrays: bool = True) -> DataFrame:
    """JSON objects in a column as extents: nested names joined by ``|``, array elements numbered, or repeated where not ``arrays``.

    The objects may differ from row to row; each is walked on its own.
    """
    leaf = "array<struct<path:string,value:string>>"
    rows = df.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(column).cast("string").alias("source"))
    flat = rows.mapInArrow(lambda b: _flattened(b, arrays), f"rec_id long, leaves {leaf}")
    one = flat.select("rec_id", F.explode("leaves").alias("l")).select("rec_id", "l.path", "l.value")
    name = F.element_at(F.split("path", r"\|"), -1)
    return extents(one, name, rec_id="rec_id", path="path", txt="value", num=V.number(F.col("value")))


def _flattened(batches, arrays):
    import pyarrow as pa

    from .formats import flatten_json

    kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
    for batch in batches:
        out = [[{"path": p, "value": v} for p, v in flatten_json(x.as_py(), arrays)] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["rec_id", "leaves"])


def csv(
    spark: SparkSession, path: str, sep: str | None = None, header: bool = True, names: Sequence[str] | None = None, key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """A CSV or TSV file: a record for each row, a field for each column.

    Without ``sep`` the first line tells whether ``,``, ``;``, a tab, ``|`` or the
    unit separator parts the cells.  Quoted line ends are kept; names may be given
    for files without a header.
    """
    if sep is None:
        first = spark.read.text(path).first()
        line = first[0] if first else ""
        sep = max(",;\t|\x1f", key=line.count)
    df = spark.read.csv(path, sep=sep, header=header, multiLine=True, escape='"', inferSchema=False)
    if names:
        df = df.toDF(*[names[n] if n < len(names) else f"FIELD{n + 1:02d}" for n in range(len(df.columns))])
    return of_columns(df, key)


def of_columns(df: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Any frame as records: the text has a line for each filled column, which is the column's extent."""
    names = df.columns
    cells = [F.col(f"`{c}`").cast("string") for c in names]
    rows = df.select(F.xxhash64(*[F.coalesce(c, F.lit("\0")) for c in cells]).alias("rec_id"), *[c.alias(f"c{n}") for n, c in enumerate(cells)])
    filled = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"c{n}").alias("txt")) for n, c in enumerate(names)]), lambda x: x["txt"].isNotNull() & (x["txt"] != ""))
    rows = rows.withColumn("cells", filled)
    text = F.array_join(F.transform("cells", lambda x: x["txt"]), "\n")
    recs = records(rows.withColumn("text", text), "rec_id", "text", **({"key": f"c{names.index(key)}"} if key else {}), doctype=F.lit("CSV"))
    start = F.aggregate(F.slice("cells", F.lit(1), F.col("n")), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["txt"]) + 1)
    one = rows.select("rec_id", "cells", F.posexplode("cells").alias("n", "c")).withColumn("start", F.when(F.col("n") > 0, start).otherwise(F.lit(0)))
    return recs, typed_extents(one.select("rec_id", F.col("c.name").alias("path"), F.col("c.txt").alias("txt"), "start"))


def typed_extents(rows: DataFrame) -> DataFrame:
    """``(rec_id, path, txt, start)``, and ``depth`` where known, as extents with what the text reads as: a number, a range, a date."""
    txt = F.col("txt")
    span, pair = V.date_span(txt), V.number_range(txt)
    name: Column = F.element_at(F.split("path", r"[|/@\\]"), -1)
    return extents(
        rows, name, rec_id="rec_id", path="path", txt=packed(txt), f_start="start", f_end=F.col("start") + F.char_length(txt) - 1,
        depth=F.col("depth") if "depth" in rows.columns else F.lit(1),
        num=F.coalesce(V.number(txt), pair["lo"]), num_hi=pair["hi"], ts_lo=span["lo"], ts_hi=span["hi"] - F.expr("INTERVAL 1 MICROSECOND"),
    )


def ndjson(spark: SparkSession, path: str, key: str | None = None, arrays: bool = True) -> tuple[DataFrame, DataFrame]:
    """A JSON object on each line: a record each, with its names as fields."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("rec_id", F.xxhash64("value"))
    k = F.get_json_object("value", f"$.{key}") if key else F.lit(None)
    return records(lines, "rec_id", "value", key=k, doctype=F.lit("NDJSON")), json_extents(lines, "rec_id", "value", arrays)
