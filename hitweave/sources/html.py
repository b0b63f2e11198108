"""Columns of HTML as records and extents, without files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..collection import EXTENT, extents, records

_FIELD = "struct<path:string,start:long,end:long,depth:int,txt:string>"
#: Characters of source that are parsed at once, but for a single row of more.
CHARS = 1 << 19


def _parsed(batches, is_html, references, wanted):
    """Rows of ``(source, ..)`` with their text and fields in place of the source, few at a time: the fields of a page take many times its size."""
    import pyarrow as pa

    from .markup import parse

    kinds = {"path": pa.string(), "start": pa.int64(), "end": pa.int64(), "depth": pa.int32(), "txt": pa.string()}
    for batch in batches:
        done, size, texts, ends, columns = 0, 0, [], [0], [[] for _ in kinds]

        def out(till):
            made = {"text": pa.array(texts, pa.string())} if "text" in wanted else {}
            if "fields" in wanted:
                fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
                made["fields"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
            kept = {f: c.slice(done, till - done) for f, c in zip(batch.schema.names[1:], batch.columns[1:], strict=True)}
            return pa.RecordBatch.from_pydict(kept | made)

        for n, x in enumerate(batch.column(0), 1):
            source = x.as_py() or ""
            text, found = parse(source, is_html, references)
            size += len(source)
            texts.append(text)
            for column, values in zip(columns, zip(*found, strict=True), strict=False):  # no values where there is no field
                column.extend(values)
            ends.append(len(columns[0]))
            if size >= CHARS or n == batch.num_rows:
                yield out(n)
                done, size, texts, ends, columns = n, 0, [], [0], [[] for _ in kinds]


def parsed(df: DataFrame, rec_id: str, source: str, is_html: bool = True, references: str = "all", wanted: tuple[str, ...] = ("text", "fields"), **columns: str) -> DataFrame:
    """``(rec_id, .., text, fields)``: the reading text of each row and its elements and attributes, or what of the two is ``wanted``, beside columns of ``df``.

    ``references``: which are decoded, of ``markup.REFERENCES``.
    """
    rows = df.select(F.col(source).cast("string").alias("_source"), F.col(rec_id).cast("long").alias("rec_id"), *[F.col(v).alias(k) for k, v in columns.items()])
    kinds = {"text": "string", "fields": f"array<{_FIELD}>"}
    schema = rows.schema.fields[1:] + T.StructType.fromDDL(", ".join(f"{w} {kinds[w]}" for w in kinds if w in wanted)).fields
    return rows.mapInArrow(lambda b: _parsed(b, is_html, references, wanted), T.StructType(schema))


def exploded(rows: DataFrame) -> DataFrame:
    """``fields`` of parsed rows as extents, typed by what their values look like."""
    f = rows.select("rec_id", F.explode("fields").alias("f")).select("rec_id", "f.*")
    name: Column = F.element_at(F.split("path", "[/@]"), -1)
    return extents(f, name, rec_id="rec_id", path="path", depth="depth", f_start="start", f_end="end", txt="txt", num=F.col("txt").try_cast("double"))


def extents_of(df: DataFrame, rec_id: str, source: str, is_html: bool = True, references: str = "all") -> DataFrame:
    return exploded(parsed(df, rec_id, source, is_html, references, ("fields",))).select(*EXTENT)


def collection_tables(df: DataFrame, rec_id: str, source: str, is_html: bool = True, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Records, with columns of ``df`` as metadata, and extents of the same pages."""
    rows = parsed(df, rec_id, source, is_html, wanted=("text",), **{f"_{k}": v for k, v in columns.items()})
    return records(rows, "rec_id", "text", **{k: f"_{k}" for k in columns}), exploded(parsed(df, rec_id, source, is_html, wanted=("fields",)))
