"""Collections: records, their field extents, and the inverted index.

``records``   rec_id, key, doctype, file_name, lang, date, .., text, rec_len, deleted
``extents``   rec_id, field, path, ftype, f_start, f_end, depth, txt, num, num_hi, ts_lo, ts_hi
``postings``  term, rec_id, tf, hits array<struct<start, end, ord>>

``f_start`` and ``f_end`` are the first and last character of an extent, as
``start`` and ``end`` are of a word; both count from 0.  Postings hold one row for
each word and record.  A task writes those of its own records, a run of texts after the
other, each run sorted by word: nothing is shuffled, a word's rows are read from few
pages of each file by their least and largest words, and a very common word spreads
over all files.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import ASCII_WORD
from .storage import spread, written

#: Columns of a record beside its id and text, with their types; what a source lacks is null.
RECORD = {
    "key": "string", "doctype": "string", "path": "string", "file_name": "string", "rec_start": "long", "rec_end": "long", "lang": "string",
    "charset": "string", "category": "int", "priority": "int", "date": "timestamp", "date_modified": "timestamp", "date_created": "timestamp",
    "date_expires": "timestamp", "deleted": "boolean",
}
#: Columns of an extent.
EXTENT = {
    "rec_id": "long", "field": "string", "path": "string", "ftype": "string", "f_start": "long", "f_end": "long", "depth": "int", "txt": "string",
    "num": "double", "num_hi": "double", "ts_lo": "timestamp", "ts_hi": "timestamp",
}
HITS = "array<struct<start:long,end:long,src:int>>"
#: As written; a hit is its start times 2**32 and its number in the record.
_POSTINGS = "term string, rec_id long, tf int, hits array<long>"


def records(df: DataFrame, rec_id: str, text: str, **columns: Column | str) -> DataFrame:
    """``df`` as records: ``columns`` gives those of ``RECORD`` that it has."""
    unknown = set(columns) - set(RECORD)
    if unknown:
        raise ValueError(f"records have no columns {sorted(unknown)}")
    own = {k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items()}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(
        F.col(rec_id).cast("long").alias("rec_id"),
        *[own.get(k, F.lit(False) if k == "deleted" else F.lit(None)).cast(t).alias(k) for k, t in RECORD.items()],
        body.alias("text"),
        F.octet_length(body).cast("long").alias("rec_len"),
    )


def extents(df: DataFrame, field: Column | str, **columns: Column | str) -> DataFrame:
    """Rows of ``df`` as instances of a field; ``columns`` gives those of ``EXTENT`` that it has.

    Names match in any case and with any separator, so they are kept in one form:
    in lower case, parted by ``/``.  The field is the last part of the path.
    """
    own = {k: (F.col(v) if isinstance(v, str) else v) for k, v in columns.items()}
    name = F.lit(field) if isinstance(field, str) else field
    own["path"] = F.regexp_replace(F.lower(own.get("path", name)), r"[\\|/]+", "/")
    own["field"] = F.lower(name)
    return df.select(*[own.get(k, F.lit(0 if k == "depth" else None)).cast(t).alias(k) for k, t in EXTENT.items()])


def by_field(exts: DataFrame) -> DataFrame:
    """Extents in the order in which each task writes them: a predicate on a field reads the row groups of that field."""
    return exts.sortWithinPartitions("field", "path", "num", "ts_lo")


#: Characters of text whose words are sorted at once: a file of postings is a row of such runs.
RUN = 8 << 20


class _Codes(dict):
    """A number for each word, from 0 on; -1 for stopwords, or where ``only`` is given for all but these."""

    def __init__(self, stop, only=None):
        super().__init__(dict.fromkeys(stop, -1) if only is None else {w: n for n, w in enumerate(sorted(only - stop))})
        self.without, self.open = len(stop) if only is None else 0, only is None

    def __missing__(self, word):
        if not self.open:
            return -1
        self[word] = n = len(self) - self.without
        return n

    def words(self):
        return [w for w, n in self.items() if n >= 0]


def _found(texts, pattern):
    """The words of some texts: ``(words, text, start, ord)``, the last three as arrays; ``ord`` counts within a text."""
    import re

    import numpy as np

    if pattern != ASCII_WORD:
        words, at, starts, ords = [], [], [], []
        for n, text in enumerate(texts):
            for i, m in enumerate(re.finditer(pattern, text)):
                words.append(m.group())
                at.append(n)
                starts.append(m.start())
                ords.append(i)
        return words, *[np.array(x, np.int64) for x in (at, starts, ords)]
    # no word goes over the ends of a text, so that all are searched as one; a byte stands for each character
    one = "\n".join(texts)
    chars = np.frombuffer(one.encode("ascii", "replace"), np.uint8)
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = ((chars >= 97) & (chars <= 122)) | ((chars >= 48) & (chars <= 57))
    starts = np.flatnonzero(np.diff(inside) == 1)
    begins = np.concatenate([[0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))[:-1]])
    at = np.searchsorted(begins, starts, "right") - 1
    return re.findall(pattern, one), at, starts - begins[at], np.arange(len(starts)) - np.searchsorted(starts, begins)[at]


def _sorted_run(codes, recs, parts):
    """The rows of a run in the order of (word, record): ``parts`` holds code, record's number, start and ord of its words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    code, rec, start, ord_ = (np.concatenate(x) for x in zip(*parts, strict=True))
    words = pa.array(codes.words(), pa.string())
    by = pc.sort_indices(words)
    rank = np.empty(len(words), np.int64)
    rank[by.to_numpy()] = np.arange(len(words))
    key = rank[code] * len(recs) + rec
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(first, len(key)).astype(np.int32)
    hits = ((start.astype(np.int64) << 32) | ord_)[order]
    own = key[first]
    rows = pa.RecordBatch.from_arrays(
        [
            words.take(by).take(pa.array(own // len(recs))), pa.array(recs, pa.int64()).take(pa.array(own % len(recs))), pa.array(np.diff(ends)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(hits)),
        ],
        ["term", "rec_id", "tf", "hits"],
    )
    for n in range(0, rows.num_rows, 50_000):
        yield rows.slice(n, 50_000)


def _posted(batches, pattern, stop, only=None):
    """A row for each word of ``(rec_id, text)``, in the order of words within runs of ``RUN`` characters.

    The number of its hits stands beside them, so that counting doesn't read them.
    """
    codes, recs, parts, size = _Codes(stop, only), [], [], 0
    texts, length = [], 0

    def add():
        import numpy as np

        words, at, start, ord_ = _found(texts, pattern)
        code = np.fromiter(map(codes.__getitem__, words), np.int32, len(words))
        kept = np.flatnonzero(code >= 0)
        if len(kept):
            parts.append([x[kept].astype(np.int32) for x in (code, at + (len(recs) - len(texts)), start, ord_)])

    for batch in batches:
        for rec, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            recs.append(rec)
            texts.append(lowered(text.as_py()))
            length += len(texts[-1]) + 1
            if length > RUN >> 4:
                add()
                size, texts, length = size + length, [], 0
                if size > RUN:
                    if parts:
                        yield from _sorted_run(codes, recs, parts)
                    codes, recs, parts, size = _Codes(stop, only), [], [], 0
    if texts:
        add()
    if parts:
        yield from _sorted_run(codes, recs, parts)


def _opened(posts: DataFrame) -> DataFrame:
    """Postings as they are read: a word ends as many characters after its start as it has."""
    hits = F.transform(
        "hits", lambda h: F.struct(F.shiftright(h, 32).cast("int").alias("start"), (F.shiftright(h, 32) + F.char_length("term") - 1).cast("int").alias("end"), h.bitwiseAND(0xFFFFFFFF).cast("int").alias("ord"))
    )
    return posts.withColumn("hits", hits)


def lowered(text: str) -> str:
    """In lower case, letter by letter where that would change the length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclasses.dataclass
class Collection:
    """Tables of one corpus.  ``postings`` may be a table on disk or a plan over ``records``.

    ``meta`` gives the columns of ``records`` but the text, ``words`` the vocabulary, ``counts`` the statistics, of an
    index that is written; each is written when it is first asked for.  ``made``: the postings are a plan over texts.
    """

    spark: SparkSession
    records: DataFrame
    postings: DataFrame
    extents: DataFrame | None = None
    pattern: str = ASCII_WORD
    stopwords: frozenset[str] = frozenset()
    aliases: dict[str, str] = dataclasses.field(default_factory=dict)
    name: str = ""
    counts: Callable[[], DataFrame] | None = None
    meta: Callable[[], DataFrame] | None = None
    words: Callable[[], DataFrame] | None = None
    made: bool = False

    @classmethod
    def of(
        cls, recs: DataFrame, exts: DataFrame | None = None, pattern: str = ASCII_WORD, stopwords: Iterable[str] = (), indexed: bool = True, name: str = "", **more
    ) -> Collection:
        """The collection of these records; ``indexed`` writes its postings, else each query makes those it needs.

        Deleted records are searched as well and left out when results are presented.
        """
        stop = frozenset(stopwords)
        if not indexed:
            return cls(recs.sparkSession, recs, _indexing(recs, pattern, stop), exts, pattern, stop, name=name, made=True, **more)
        rows = written(_packed(spread(recs), pattern, stop), "postings", compression="zstd")
        meta = functools.cache(lambda: written(recs.drop("text"), "meta"))
        counts = functools.cache(lambda: written(_counted(meta()), "counts"))
        words = functools.cache(lambda: written(_vocabulary(rows).sortWithinPartitions("term"), "vocabulary"))
        return cls(recs.sparkSession, recs, _opened(rows), exts, pattern, stop, name=name, counts=counts, meta=meta, words=words, **more)

    def posted(self, *words: str) -> DataFrame:
        """The postings of some words, by name; where they are made from texts, of these words alone."""
        rows = _indexing(self.records, self.pattern, self.stopwords, frozenset(words)) if self.made else self.postings
        return rows.where(F.col("term") == words[0] if len(words) == 1 else F.col("term").isin(sorted(words)))

    def indexing(self, recs: DataFrame) -> DataFrame:
        """The postings of some records, made from their texts."""
        return _indexing(recs, self.pattern, self.stopwords)

    def imported(self, other: Collection) -> Collection:
        """This collection with another's records, which get ids beyond the largest of this one's."""
        last = self.records.agg(F.coalesce(F.max("rec_id"), F.lit(-1))).first()[0]
        first = other.records.agg(F.coalesce(F.min("rec_id"), F.lit(0))).first()[0]

        def moved(df: DataFrame) -> DataFrame:
            return df.withColumn("rec_id", F.col("rec_id") + F.lit(last + 1 - first))

        exts = [x for x in (self.extents, moved(other.extents) if other.extents is not None else None) if x is not None]
        return Collection(
            self.spark, self.records.unionByName(moved(other.records)), self.postings.unionByName(moved(other.postings)),
            exts[0].unionByName(exts[1]) if len(exts) == 2 else exts[0] if exts else None, self.pattern, self.stopwords, self.aliases, self.name,
        )

    def vocabulary(self) -> DataFrame:
        """``(term, tf, df)`` of all words."""
        return _vocabulary(self.postings) if self.words is None else self.words()

    def described(self) -> DataFrame:
        """The records' columns but the text, without a scan of it where the index is written."""
        return self.records.drop("text") if self.meta is None else self.meta()

    def statistics(self) -> DataFrame:
        """One row: ``n_records`` and ``avg_len`` over all records, deleted ones too."""
        return _counted(self.records) if self.counts is None else self.counts()


def _packed(recs: DataFrame, pattern: str, stop: frozenset[str], only: frozenset[str] | None = None) -> DataFrame:
    return recs.select("rec_id", "text").mapInArrow(lambda b: _posted(b, pattern, stop, only), _POSTINGS)


def _indexing(recs: DataFrame, pattern: str, stop: frozenset[str], only: frozenset[str] | None = None) -> DataFrame:
    return _opened(_packed(recs, pattern, stop, only))


def _vocabulary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def _counted(recs: DataFrame) -> DataFrame:
    return recs.agg(F.count(F.lit(1)).alias("n_records"), F.avg("rec_len").alias("avg_len"))
