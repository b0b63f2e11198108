"""Reading files through a format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import records
from ..functions.values import date_span
from ..storage import written
from .formats import FORMATS
from .tables import typed_extents

_DOC = (
    "file string, n long, key string, doctype string, date string, rec_start long, rec_end long, deleted boolean, text string, "
    "fields array<struct<path:string,start:long,end:long,depth:int,txt:string>>"
)


#: How the records of some formats are told apart without reading the file from its start: what parts them, and what of that
#: begins the next one or ends the one before.  Of "</>" the tag is the record's.  Empty lines alone are no such mark: of
#: three line ends in a row a part that begins between them sees another two than the part before.
_PARTED = {
    "RIS": ("\nTY  - ", "TY  - ", ""), "MEDLINE": ("\nPMID- ", "PMID- ", ""), "DIALOG-B": ("\nAN- ", "AN- ", ""),
    "REFERBIB": ("\n\n%", "%", ""), "ENDNOTE": ("\n\n%", "%", ""), "MAILFOLDER": ("\n\nFrom ", "From ", ""), "NEWSFOLDER": ("\n\nFrom ", "From ", ""),
    "ONELINE": ("\n", "", ""), "NDJSON": ("\n", "", ""), "JSONL": ("\n", "", ""),
    "RSS": ("</item>", "", "</item>"), "ATOM": ("</entry>", "", "</entry>"), "XML": ("</>", "", "</>"),
}


def _rows(file, first, docs):
    """Parsed records as a batch of ``_DOC``, numbered from ``first``."""
    import pyarrow as pa

    names = [x.split()[0] for x in _DOC.split(", ")]
    kind = pa.list_(pa.struct([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("txt", pa.string())]))
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), kind]
    out = [[] for _ in names]
    for n, doc in enumerate(docs, first):
        fields = [{"path": f.path, "start": f.start, "end": f.end, "depth": f.depth, "txt": f.txt if f.txt is not None or f.start is None else doc.text[f.start : f.end + 1]} for f in doc.fields]
        for column, value in zip(out, (file, n, doc.key, doc.doctype, doc.date, doc.begin, doc.end, doc.deleted, doc.text, fields), strict=True):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def _read(batches, format, options):
    from .formats import FORMATS, decoded

    make = format if not isinstance(format, str) else FORMATS[format.upper()]
    for batch in batches:
        for row in range(batch.num_rows):  # a file at a time: its records may be large
            data = batch.column(1)[row].as_py() or b""
            yield _rows(batch.column(0)[row].as_py(), 0, make(data if getattr(make, "binary", False) else decoded(data), **options))


def _pieces(batches, make, options, lead, trail):
    """Records of rows ``(file, where its part begins, piece)``; the rows of a part come in their order."""
    import dataclasses

    from .formats import decoded

    part, n = None, 0
    for batch in batches:
        made = []
        for row in range(batch.num_rows):
            at = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            first = at != part and at[1] == 0
            if at != part:
                made, part, n = [*made, (*at, 0, [])], at, 0
            elif not made:
                made.append((*at, n, []))
            piece = batch.column(2)[row].as_py() or b""
            # the place of a piece in its file isn't known
            docs = [dataclasses.replace(d, begin=None, end=None) for d in make(decoded((b"" if first else lead) + piece + trail), **options)]
            made[-1][3].extend(docs)
            n += len(docs)
        for file, start, before, docs in made:
            yield _rows(file, start + before, docs)


def read(
    spark: SparkSession, path: str, format: str = "AUTODETECT", glob: str | None = None, recursive: bool = True, split: bool = False, **options
) -> tuple[DataFrame, DataFrame]:
    """Records and extents of all files under ``path`` whose names match ``glob``.

    A file is read as a whole by one task, so it has at most 2 GB; a record's id is
    a hash of its file and number.  With ``split``, files of the formats whose
    records are told apart by a mark (``_PARTED``; lines end with ``\\n``, elements of
    one tag don't nest, UTF-8 or Latin-1) are of any size and cut among tasks:
    records have no place in their file then, and are numbered by their part's
    place, which depends on ``spark.sql.files.maxPartitionBytes``.  ``tables`` has
    readers for CSV and for lines of JSON.  Records that a bulk file deletes come
    with ``deleted``.
    """
    make = FORMATS[format.upper()] if isinstance(format, str) else format
    if split and format.upper() not in _PARTED:
        raise ValueError(f"records of {format} can't be told apart within a file; of {', '.join(_PARTED)} they can")
    files = spark.read.format("text" if split else "binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        files = files.option("pathGlobFilter", glob)
    if split:
        tag = options.get("row_tag")
        if format.upper() == "XML" and not tag:
            raise ValueError("the elements that are records are named by row_tag")
        mark, lead, trail = (x.replace("</>", f"</{tag}>") for x in _PARTED[format.upper()])
        pieces = files.option("lineSep", mark).load(path).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
        docs = pieces.mapInArrow(lambda b: _pieces(b, make, options, lead.encode(), trail.encode()), _DOC)
    else:
        docs = files.load(path).select("path", "content").mapInArrow(lambda b: _read(b, make, options), _DOC)
    return _tables(written(docs, "parsed"))


def _tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed records as the tables of a collection."""
    docs = docs.withColumn("rec_id", F.xxhash64("file", "n"))
    recs = records(
        docs, "rec_id", "text", key=F.coalesce("key", F.concat_ws("#", F.element_at(F.split("file", "/"), -1), "n")), doctype="doctype", path="file",
        file_name=F.element_at(F.split("file", "/"), -1), rec_start="rec_start", rec_end="rec_end", date=date_span(F.col("date"))["lo"], deleted="deleted",
    )
    fields = docs.select("rec_id", F.explode("fields").alias("f")).select("rec_id", "f.path", "f.txt", "f.start", "f.end", "f.depth")
    return recs, typed_extents(fields)
