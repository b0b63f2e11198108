"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most four of 64 bits are brought together
without comparing all pairs:

* The bits are cut into six blocks.  However four differing bits fall on six
  blocks, one of the six block triples of ``TRIPLES`` holds at most one of them
  (checked by the tests for every distribution).
* In each triple the anchors are the words of the perfect [31,26] Hamming code
  (covering radius 1) on 31 of its bits, next to the bits left over.  A
  fingerprint's home is the anchor within the covering radius; it is replicated
  to every anchor within that radius plus the threshold of 1, which is every
  place where a fingerprint one bit away can have its home.
* Each anchor compares its homes with its visitors, in full width.

Only distinct fingerprints take part, so copies of one text cost one row.
Anchors with many homes are cut into blocks that different tasks compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._base import components, extended, meet, written

#: Triples of the six blocks; see the module's text.
TRIPLES = ((0, 1, 2), (0, 1, 3), (0, 4, 5), (1, 4, 5), (2, 3, 4), (2, 3, 5))
#: First bit of each block, and the end.  Every triple has at least 31 bits.
BLOCKS = (0, 10, 21, 31, 42, 53, 64)
#: Homes of one anchor that one task compares with the anchor's visitors.
HOMES = 4096
#: Heavy anchors that are broadcast at most; more are joined by a shuffle.
HEAVY = 100_000


def majority(hashes):
    """The bits that over half of the 64-bit hashes have; 0 for none."""
    import numpy as np

    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0]


def _fingerprints(batches, shingle):
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            words = (text or b"").lower().split()
            if not words:
                continue
            if len(words) <= shingle:
                hashes = [digest(b" ".join(words), 42)]
            else:
                line = b" ".join(words)
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                ends = np.cumsum(sizes + 1) - 1
                hashes = [digest(line[s:e], 42) for s, e in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())]
            out[row] = majority(hashes)
        yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(out.view(np.int64))], ["id", *batch.schema.names[2:], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carry: Iterable[str] = ()) -> DataFrame:
    """``(id long, *carry, fp long)`` for every row: the SimHash of the whole text's word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased; every
    shingle counts as often as it occurs; a bit is 1 if more than half of the
    shingles' XXH64 hashes (seed 42) have it.  A text of fewer words is one
    shingle; null and wordless texts get 0.
    """
    carry = list(carry)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    )
    schema = T.StructType([rows.schema["id"], *extended(rows, 2, "fp long").fields])
    got = rows.mapInArrow(lambda batches: _fingerprints(batches, shingle), schema)
    return got.select("id", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "fp")


def _tables():
    """For each syndrome: what leads from a 31-bit word to its own anchor, and to all near anchors."""
    import numpy as np

    parity = np.zeros((4, 256), np.int64)  # the syndrome of each byte of a word
    for byte in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * byte + bit < 31:
                    parity[byte, value] ^= 8 * byte + bit + 1
    flip = np.array([0, *(1 << i for i in range(31))], np.int64)
    near = np.zeros((32, 15), np.int64)
    for s in range(1, 32):
        near[s] = [flip[i] ^ flip[s ^ i] for i in range(1, 32) if i < s ^ i]
    return parity, flip, near


def _anchors(batches, homes_only):
    """Rows (key, role, fp): role 0 at the home anchors, 1 as a visitor."""
    import numpy as np
    import pyarrow as pa

    parity, flip, near = _tables()
    one = np.int64(1)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        bits = fp.view(np.uint64)
        keys, roles, fps = [], [], []
        for t, triple in enumerate(TRIPLES):
            word, width = np.zeros(len(fp), np.int64), 0
            for b in triple:
                size = BLOCKS[b + 1] - BLOCKS[b]
                part = (bits >> np.uint64(BLOCKS[b])) & np.uint64((1 << size) - 1)
                word |= part.astype(np.int64) << width
                width += size
            code, rest = word & ((one << 31) - 1), word >> 31
            syndrome = parity[0, code & 255] ^ parity[1, code >> 8 & 255] ^ parity[2, code >> 16 & 255] ^ parity[3, code >> 24]
            top = (np.int64(t) << 40) | (rest << 31)
            home = top | (code ^ flip[syndrome])
            keys.append(home)
            roles.append(np.zeros(len(fp), np.int8))
            fps.append(fp)
            if homes_only:
                continue
            for extra in range(width - 31):
                keys.append(home ^ (one << (31 + extra)))
                fps.append(fp)
            some = syndrome > 0
            far = (top | code)[some, None] ^ near[syndrome[some]]
            keys.append(far.reshape(-1))
            fps.append(np.repeat(fp[some], 15))
            roles.append(np.ones(far.size + (width - 31) * len(fp), np.int8))
        keys, roles, fps = map(np.concatenate, (keys, roles, fps))
        for at in range(0, len(keys), 1 << 17):
            cut = slice(at, at + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut]), pa.array(roles[cut]), pa.array(fps[cut])], ["key", "role", "fp"])


def _compared(batches, threshold):
    """Links within runs of (key, block) of sorted rows (key, block, role, fp), homes first.

    Of a visitor and all homes near it, each is linked to the smallest of them:
    that connects what is linked, in as many rows as there are members.
    """
    import numpy as np
    import pyarrow as pa

    held = [np.zeros(0, np.int64) for _ in range(3)]  # key, block, fp of the last group's homes
    for batch in batches:
        key, block, role, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(key):
            continue
        fresh = np.concatenate([np.zeros(len(held[0]), bool), np.ones(len(key), bool)])
        role = np.concatenate([np.zeros(len(held[0]), np.int8), role])
        key, block, fp = (np.concatenate(x) for x in zip(held, (key, block, fp), strict=True))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        homes = np.add.reduceat((role == 0).astype(np.int64), starts)
        last = starts[-1]
        held = [x[last : last + homes[-1]].copy() for x in (key, block, fp)]
        ask = np.flatnonzero(fresh & (homes[group] > 0))
        todo = np.cumsum(homes[group[ask]])
        at = 0
        while at < len(ask):  # some 4 million comparisons at a time
            end = max(at + 1, int(np.searchsorted(todo, (todo[at - 1] if at else 0) + (1 << 22), "right")))
            some, at = ask[at:end], end
            n = homes[group[some]]
            who = np.repeat(some, n)
            other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[some]], n)
            apart = np.bitwise_count((fp[who] ^ fp[other]).view(np.uint64))
            hit = (apart > 0) & (apart <= threshold)
            who, other = who[hit], other[hit]
            if not len(who):
                continue
            firsts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            low = np.minimum(np.minimum.reduceat(fp[other], firsts), fp[who[firsts]])
            sizes = np.diff(np.append(firsts, len(who)))
            a = np.concatenate([fp[who[firsts]], fp[other]])
            b = np.concatenate([low, np.repeat(low, sizes)])
            pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def links(fps: DataFrame, threshold: int = 4, homes: int = HOMES) -> DataFrame:
    """``(a, b)`` pairs of fingerprints that connect all of ``fps(fp)`` at most ``threshold`` (to 4) bits apart.

    ``fps`` holds each fingerprint once.  The pairs span the classes of linked
    fingerprints; they need not hold every link within a class.
    """
    if not 0 <= threshold <= 4:
        raise ValueError("the covering design serves thresholds from 0 to 4")
    fps = fps.select("fp")
    count = fps.mapInArrow(lambda b: _anchors(b, True), "key long, role byte, fp long").groupBy("key").count()
    heavy = written(count.where(F.col("count") > homes).select("key", F.ceil(F.col("count") / homes).cast("int").alias("blocks")), "heavy")
    n = heavy.count()
    rows = fps.mapInArrow(lambda b: _anchors(b, False), "key long, role byte, fp long")
    if n:
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        cut = rows.join(F.broadcast(heavy) if n <= HEAVY else heavy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = cut.select("key", "role", "fp", own.alias("own"), spread).select(
            "key", "block", F.when(F.col("block") == F.col("own"), F.col("role")).otherwise(F.lit(1)).cast("byte").alias("role"), "fp"
        )
    else:
        rows = rows.select("key", F.lit(0).alias("block"), "role", "fp")
    return (
        rows.repartition("key", "block")
        .sortWithinPartitions("key", "block", "role")
        .mapInArrow(lambda b: _compared(b, threshold), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4, homes: int = HOMES
) -> DataFrame:
    """``(id, fp, component)`` for every row of ``docs``: its fingerprint and the smallest id it is linked to.

    Rows whose fingerprints differ in at most ``threshold`` bits are linked, and
    so are those linked through others.  Null, empty and wordless texts have
    fingerprint zero and are linked like any other; rows repeated under one id
    give one row each; a null id stands for itself where no other id is linked.
    Other columns of ``docs`` don't matter.
    """
    marks, owner = _classes(docs, id_col, text_col, shingle, threshold, homes)
    return meet(marks, written(owner, "classes"), "fp").select("id", "fp", "component")


def _classes(docs, id_col, text_col, shingle, threshold, homes) -> tuple[DataFrame, DataFrame]:
    """``(id, fp)`` of every row, and ``(fp, root, component)`` of every fingerprint."""
    marks = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = written(marks.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    joined = components(links(least, threshold, homes)).withColumnRenamed("node", "fp")
    roots = written(least.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component"))
    return marks, meet(roots, smallest, "root").select("fp", "root", "component")


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4, homes: int = HOMES
) -> DataFrame:
    """The rows of ``docs``, with their columns, of which one stays of each class: that of the smallest id.

    Of rows that repeat the smallest id, the one with the smallest text stays,
    and rows without an id stay only where their class has no other.
    """
    marks, owner = _classes(docs, id_col, text_col, shingle, threshold, homes)
    return survivors(docs, marks, owner, lambda d, i, t, carry: fingerprints(d, i, t, shingle, carry), id_col, text_col)


def survivors(docs: DataFrame, marks: DataFrame, owner: DataFrame, mark: Callable[..., DataFrame], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` of which one stays of each class of ``owner(fp, root, component)``.

    ``marks``: (id, fp) of every row, by ``mark``.
    """
    owner = written(owner, "classes")
    again = written(marks.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated")
    gone = written(meet(marks, owner, "fp").where("id <> component").select("id").distinct(), "duplicates")
    number = docs[id_col].cast("long")

    def having(some: DataFrame, how: str, rows: DataFrame = docs) -> DataFrame:
        return rows.join(some, number == some["id"], how)

    if not marks.where("id is null").limit(1).count() + again.limit(1).count():
        return having(gone, "left_anti")
    clear = having(gone, "left_anti", having(again, "left_anti", docs.where(number.isNotNull())))
    rest = docs.where(number.isNull()).unionByName(having(again, "left_semi"))
    names = docs.columns
    rows = mark(rest.toDF(*[f"r{i}" for i in range(len(names))]), f"r{names.index(id_col)}", f"r{names.index(text_col)}", [f"r{i}" for i in range(len(names))])
    rows = rows.join(owner, "fp").where("component is null or id = component")
    first = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), F.col(f"r{names.index(text_col)}"))
    rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    return clear.unionByName(rows.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(names)]))
