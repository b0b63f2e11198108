"""Benchmark decontamination by winnowing.

A word k-gram of every window of ``n`` words is its fingerprint: the one with the
smallest hash, the leftmost on ties.  Documents and benchmark items pick theirs by
the same rule, so a window that the two share has the same fingerprint in both;
with k-grams of ``n // 2`` words that guarantees every shared span of ``n`` words.
An item of fewer than ``n`` words is a window, and a fingerprint, as a whole.

1. The items' fingerprints are written as a table, each with the words around it.
2. Documents keep their fingerprints that a bitmap of the items' (at most ``BITS``
   bits, broadcast) doesn't rule out, with the words around them.
3. The two are joined on the fingerprint, in a way that no hot one lands in one task.
4. A hit is extended word by word, to the left and to the right, as far as a window
   with it can reach: where that makes ``n`` words, they are hit, and the item occurs.
   Fingerprints with more than ``MANY`` different surroundings in the benchmark aren't
   compared with each of these: their windows are joined as texts.

The benchmark may be of any size: nothing of it but the bitmap is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import WORD_BYTES, free, meet, small, written

#: Bits of the broadcast bitmap at most (8 MB).  A fuller one lets more through to the join.
BITS = 1 << 26
#: Bytes of documents that are tokenised at a time; a longer text is read in pieces.
CHUNK = 1 << 20
#: Surroundings of one fingerprint that a hit is compared with one by one.
MANY = 256
#: Words whose hash a task remembers.
REMEMBERED = 100_000

_MULTIPLIER = 0x9E3779B97F4A7C15
#: Every byte of a word as ``w``, any other as a space.
_SHAPE = bytes(32 if c == 32 else 119 for c in WORD_BYTES)


class _Hashes(dict):
    """Words' hashes as they come; forgets all when it grows large."""

    def __missing__(self, word):
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _counted(texts):
    """The number of words of each text, without making them."""
    import pyarrow as pa

    return pa.array([(b" " + (x.as_py() or b"").translate(_SHAPE)).count(b" w") for x in texts.cast(pa.binary())], pa.int64())


def _grams(hashes, k):
    """The hash of the k words from each place on; never zero."""
    import numpy as np

    size = max(0, len(hashes) - k + 1)
    out, factor = np.full(size, k, np.uint64), np.uint64(_MULTIPLIER)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * factor + hashes[j : size + j]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (out ^ (out >> np.uint64(29))) | np.uint64(1)


def _winnowed(hashes, owner, n, k):
    """Places of the fingerprints of all windows of n words that have one owner, and their hashes."""
    import numpy as np

    grams, width = _grams(hashes, k), n - k + 1
    windows = len(hashes) - n + 1
    if windows < 1:
        return np.zeros(0, np.int64), grams[:0]
    whole = np.flatnonzero(owner[:windows] == owner[n - 1 :])
    best = np.lib.stride_tricks.sliding_window_view(grams, width)[whole].argmin(axis=1) + whole
    best = np.unique(best)
    return best, grams[best]


def _pieces(text: bytes, overlap: int):
    """A text's words in runs of some megabytes, each with its first word's number; a run starts with the last ``overlap`` words of the one before."""
    if len(text) <= CHUNK:
        yield 0, text.translate(WORD_BYTES).split()
        return
    text = text.translate(WORD_BYTES)
    at = number = 0
    tail: list[bytes] = []
    while at < len(text):
        end = text.find(b" ", min(len(text), at + CHUNK))
        end = len(text) if end < 0 else end
        words = tail + text[at:end].split()
        yield number, words
        tail = words[max(0, len(words) - overlap) :]
        number += len(words) - len(tail)
        at = end


def _runs(texts, overlap):
    """Texts by some megabytes: (words, each one's owner, and (row, number of the first word, place here) of the owners)."""
    import numpy as np

    words: list[bytes] = []
    owners, sizes = [], []
    for row, text in enumerate(texts):
        for number, some in _pieces(text.as_py() or b"", overlap):
            owners.append((row, number, len(words)))
            sizes.append(len(some))
            words += some
            if len(words) > CHUNK // 8:
                yield words, np.repeat(np.arange(len(owners)), sizes), owners
                words, owners, sizes = [], [], []
    if words:
        yield words, np.repeat(np.arange(len(owners)), sizes), owners


#: A fingerprint of ``size`` words and the words around it: up to those that a window with it can hold.
_PRINT = "print long, size int, before string, after string"


def _listed(batches, n):
    """Rows (item, *_PRINT) of an item's fingerprints."""
    import numpy as np
    import pyarrow as pa

    k, hashes = n // 2, _Hashes()
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        rows, out = [], [[] for _ in range(4)]
        for row in range(batch.num_rows):
            for _, words in _pieces(texts[row].as_py() or b"", n - 1):
                ids = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
                if 0 < len(words) < n:
                    size, places, found = len(words), [0], _grams(ids, len(words))
                else:
                    size = k
                    places, found = _winnowed(ids, np.zeros(len(ids), np.int64), n, k)
                for at, print_ in zip(places, found.view(np.int64).tolist(), strict=True):
                    rows.append(row)
                    before = words[max(0, at - (n - k)) : at]
                    for column, value in zip(out, (print_, size, b" ".join(before).decode(), b" ".join(words[at : at + n]).decode()), strict=True):
                        column.append(value)
        item = batch.column(0).take(pa.array(rows, pa.int64()))
        types = (pa.int64(), pa.int32(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([item, *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["item", "print", "size", "before", "after"])


def _met(batches, n, shorts, bitmap):
    """Rows (a, b, at, *_PRINT) of the documents' fingerprints that the bitmap lets through."""
    import numpy as np
    import pyarrow as pa

    k, hashes, bits = n // 2, _Hashes(), np.frombuffer(bitmap.value, np.uint8)
    mask = np.uint64(8 * len(bits) - 1)
    for batch in batches:
        for words, owner, owners in _runs(batch.column(2).cast(pa.binary()), n - 1):
            ids = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
            some = [(k, *_winnowed(ids, owner, n, k))]
            for size in shorts:
                whole = np.flatnonzero(owner[: max(0, len(ids) - size + 1)] == owner[size - 1 :])
                some.append((size, whole, _grams(ids, size)[whole]))
            rows, numbers, out = [], [], [[] for _ in range(4)]
            for size, places, found in some:
                place = found & mask
                known = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                for at, print_ in zip(places[known].tolist(), found[known].view(np.int64).tolist(), strict=True):
                    row, number, first = owners[owner[at]]
                    end = owners[owner[at] + 1][2] if owner[at] + 1 < len(owners) else len(words)
                    rows.append(row)
                    numbers.append(number + at - first)
                    short = size in shorts and size != k
                    before, after = ([], words[at : at + size]) if short else (words[max(first, at - (n - k)) : at], words[at : min(end, at + n)])
                    for column, value in zip(out, (print_, size, b" ".join(before).decode(), b" ".join(after).decode()), strict=True):
                        column.append(value)
            if rows:
                rows = pa.array(rows, pa.int64())
                types = (pa.int64(), pa.int32(), pa.string(), pa.string())
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(numbers, pa.int64()), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "at", "print", "size", "before", "after"])


_HIT = "a long, b long, start long, end long, items array<string>"


def _extended(batches, n):
    """Hits of rows (a, b, at, before, after, contexts): words that agree with a context's, if there are enough of them."""
    import pyarrow as pa

    def common(x, y):
        found = 0
        for p, q in zip(x, y):
            if p != q:
                break
            found += 1
        return found

    for batch in batches:
        out = [[] for _ in range(5)]
        for a, b, at, before, after, contexts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            before, after = before.split()[::-1], after.split()
            for x in contexts:
                theirs = x["after"].split()
                right = common(after, theirs)
                if right < x["size"]:
                    continue  # another k-gram of the same hash
                left = common(before, x["before"].split()[::-1])
                if x["whole"] or left + right >= n:
                    for column, value in zip(out, (a, b, at - (0 if x["whole"] else left), at + (x["size"] if x["whole"] else right), x["items"]), strict=True):
                        column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["a", "b", "start", "end", "items"])


def _windows(batches, n, place):
    """The windows with a fingerprint of rows (.., before, after), as texts; ``place``: the column of the fingerprint's place, moved to the window's."""
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names
        before, after = (batch.column(names.index(c)).to_pylist() for c in ("before", "after"))
        rows, starts, texts = [], [], []
        for row, (left, right) in enumerate(zip(before, after, strict=True)):
            left = left.split()
            words = left + right.split()
            for first in range(max(0, min(len(left), len(words) - n) + 1)) if len(words) >= n else ():
                rows.append(row)
                starts.append(first - len(left))
                texts.append(" ".join(words[first : first + n]))
        got = batch.take(pa.array(rows, pa.int64()))
        columns = {c: got.column(c) for c in names if c not in ("before", "after")}
        if place:
            columns[place] = pa.array([x + s for x, s in zip(got.column(place).to_pylist(), starts, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(texts, pa.string())], [*columns, "window"])


def _bitmap(prints: DataFrame) -> bytes:
    """Bits at the prints modulo their number: a power of two, at most ``BITS``, 256 or more for each print where that allows it."""
    import numpy as np

    number = prints.count()
    size = min(BITS, 1 << max(15, (256 * number).bit_length()))
    out = np.zeros(size // 8, np.uint8)
    place = F.pmod(F.col("print"), F.lit(size))
    parts = prints.select(place.alias("place")).groupBy(F.expr("place div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("place % 32768")).alias("bits"))
    for part in parts.toLocalIterator():  # at most BITS / 32768 rows of 4 kB
        out[4096 * part["part"] : 4096 * (part["part"] + 1)] = np.frombuffer(part.bits, np.uint8)
    return out.tobytes()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    carry: Iterable[str] = (),
    suffix: str = "",
) -> DataFrame:
    """``(*carry, n_words, n_hit, spans, items)`` for every row of ``docs``, with the columns named in ``carry``.

    ``spans``: runs of hit words (first, and one past the last); ``items``: the
    ids, as strings, of the items with occurring windows, sorted.  An item of
    fewer than ``n`` words is one window; a text that is null, empty or without
    words has none.  An item without an id marks words, but is not listed; rows
    repeated in ``benchmark`` count once, rows repeated in ``docs`` each give a row.
    ``suffix`` ends the names of the four columns, which give way to carried ones
    of their names by underscores.  Texts are told apart by a hash of 128 bits.
    """
    if n < 2:
        raise ValueError("a window takes two words or more")
    spark, carry = docs.sparkSession, list(carry)
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    prints = bench.mapInArrow(lambda b: _listed(b, n), "item string, " + _PRINT)
    # distinct contexts, with all their items
    contexts = written(prints.groupBy("print", "size", "before", "after").agg(F.sort_array(F.collect_set("item")).alias("items")), "contexts")
    whole = (F.col("before") == "") & (F.size(F.split("after", " ")) == F.col("size"))
    shorts = sorted(r["size"] for r in contexts.where(whole).select("size").distinct().collect())  # below n
    many = written(contexts.where(~whole).groupBy("print").count().where(F.col("count") > MANY).select("print"), "many")
    by_print = contexts.join(many, "print", "left_anti").unionByName(contexts.join(many, "print", "left_semi").where(whole)).groupBy("print").agg(F.collect_list(F.struct("size", "before", "after", "items", whole.alias("whole"))).alias("contexts"))
    bitmap = spark.sparkContext.broadcast(_bitmap(contexts.select("print").distinct()))
    text = F.col(text_col).cast("string")
    key = [F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b")]
    met = docs.select(*key, text.alias("text")).mapInArrow(lambda b: _met(b, n, shorts, bitmap), f"a long, b long, at long, {_PRINT}")
    met = written(met.distinct(), "met")  # copies of a text once
    hits = meet(met.drop("size"), by_print, "print").select("a", "b", "at", "before", "after", "contexts").mapInArrow(lambda b: _extended(b, n), _HIT)
    if many.limit(1).count():
        theirs = contexts.where(~whole).join(many, "print", "left_semi").select("items", "before", "after").mapInArrow(lambda b: _windows(b, n, None), "items array<string>, window string")
        theirs = theirs.groupBy("window").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        ours = met.join(many, "print", "left_semi").select("a", "b", "at", "before", "after").mapInArrow(lambda b: _windows(b, n, "at"), "a long, b long, at long, window string")
        hits = hits.unionByName(meet(written(ours.distinct(), "windows"), theirs, "window").select("a", "b", F.col("at").alias("start"), (F.col("at") + n).alias("end"), "items"))
    found = hits.groupBy("a", "b").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    found = written(found.select("a", "b", _merged(F.col("spans")).alias("spans"), "items"), "hits")
    names = [f"_c{i}" for i in range(len(carry))]
    # a byte at a time in Python is faster than Java's regular expressions; left out where nobody asks for it
    n_words = F.arrow_udf(_counted, "long", F.ArrowUDFType.SCALAR)(text)
    # the rows' own columns travel in a struct, whatever their names
    rows = docs.select(*key, n_words.alias("n_words"), *[F.col(c).alias(m) for c, m in zip(carry, names, strict=True)])
    got = rows.join(F.broadcast(found), ["a", "b"], "left") if small(found) else meet(rows, found, ["a", "b"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["end"] - x["start"])
    own = [F.col("n_words"), hit, spans, F.coalesce("items", F.array().cast("array<string>"))]
    return got.select(*[F.col(m).alias(c) for c, m in zip(carry, names, strict=True)], *[c.alias(m) for c, m in zip(own, free(("n_words", "n_hit", "spans", "items"), carry, suffix), strict=True)])


def _merged(spans):
    """Sorted spans as runs: those that overlap or touch become one."""
    start = F.array().cast("array<struct<start:long,end:long>>")

    def step(a, x):
        last = F.element_at(a, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(spans, start, step)
