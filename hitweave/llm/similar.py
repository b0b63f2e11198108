"""Near-duplicates by the Jaccard similarity of word shingles.

All texts whose sets of shingles have a similarity of at least ``SIMILARITY``
are linked:

* Candidates are, by the anchors of ``simhash``, all sets whose SimHashes differ
  in at most four of 64 bits; that reaches the nearest pairs only.
* Candidates are also what shares one of ``BANDS`` bands of ``ROWS`` MinHashes
  each, and differs in at most ``APART`` of the 128 bits that the MinHashes'
  lowest bits make.  Of a pair at 0.8 the bands miss 5 in 10**8 and the bits 2
  in 10**8; above that fewer.
* What candidates connect is brought together with its whole sets, and compared
  exactly: rare shingles first, texts of a class that is linked already are
  left out, and no other pair is that could be similar enough.
* A class of candidates of more than ``CLASS_BYTES`` is cut into blocks of that
  size, so that no task holds more than two of them: each block is compared in
  itself, then with the class's first block, which brings a true class together
  but for a few; these few are compared with all blocks.  Of a band with more
  than ``KEY_ROWS`` rows all are candidates, and none is held.

Only distinct sets take part, so copies of one text cost one row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import components, extended, meet, written
from .simhash import links, majority, survivors

#: The least similarity that links, as a fraction.
SIMILARITY = (4, 5)
#: Bands of MinHashes, and how many make one.
BANDS, ROWS = 32, 4
#: Differing bits of candidates' sketches at most.
APART = 36
#: Bits of the map of what has candidates at most (8 MB, broadcast); beyond that more of the others travel with them.
BITS = 1 << 26
#: Bytes of sets that make a block of a class of candidates, about.
CLASS_BYTES = 8 << 20
#: Rows of one band that are compared with each other by their sketches, at most.
KEY_ROWS = 1 << 15
#: Shingles hashed at a time.
STEP = 2048


def _shingles(text, shingle):
    """The sorted distinct hashes of a text's shingles (bytes); those of a text of fewer words are one."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[shingle - 1 :] if len(words) > shingle else ends[-1:]
    return np.unique(np.array([digest(line[s:e], 42) for s, e in zip((ends - sizes).tolist(), last.tolist())], np.uint64))


def _seeds():
    import numpy as np

    made = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
    return made[0], made[1] << np.uint64(1) | np.uint64(1)


def _sketch(hashes, seeds):
    """128 bits and the keys of the bands, as bytes."""
    import numpy as np

    flip, odd = seeds
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), STEP):
        mixed = (hashes[None, at : at + STEP] ^ flip) * odd
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, mixed.min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
    return np.packbits((least & np.uint64(1)).astype(np.uint8)).tobytes() + keys.tobytes()


def _marked(batches, shingle, whole):
    import numpy as np
    import pyarrow as pa
    import xxhash

    seeds = _seeds()
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        fps, sets, sketches, simhashes = np.zeros(batch.num_rows, np.uint64), [], [], np.zeros(batch.num_rows, np.uint64)
        for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
            hashes = _shingles(text, shingle)
            if len(hashes):
                fps[row] = xxhash.xxh64_intdigest(hashes.tobytes(), 42)
            if whole:
                sets.append(hashes.tobytes())
                sketches.append(_sketch(hashes, seeds) if len(hashes) else None)
                simhashes[row] = majority(hashes)
        more = [pa.array(sets, pa.binary()), pa.array(sketches, pa.binary()), pa.array(simhashes.view(np.int64))] if whole else []
        names = ["id", *batch.schema.names[2:], "fp", *(["hashes", "sketch", "simhash"] if whole else [])]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fps.view(np.int64)), *more], names)


def marks(docs: DataFrame, id_col: str, text_col: str, shingle: int, carry: Iterable[str] = (), whole: bool = False) -> DataFrame:
    """``(id long, *carry, fp long)`` for every row: a hash of the whole text's set of shingles; 0 for wordless texts.

    ``whole`` adds the set, its sketch and its SimHash.
    """
    carry = list(carry)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    )
    more = extended(rows, 2, "fp long, hashes binary, sketch binary, simhash long" if whole else "fp long").fields
    got = rows.mapInArrow(lambda batches: _marked(batches, shingle, whole), T.StructType([rows.schema["id"], *more]))
    return got.select("id", *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "fp", *(["hashes", "sketch", "simhash"] if whole else []))


def _anchored(sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all of ``sets(simhash, fp)``, a written table, whose SimHashes differ in at most four bits."""
    heads = written(sets.groupBy("simhash").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")), "simhashes")
    same = meet(sets, heads.where("n > 1").select("simhash", "head"), "simhash").select(F.col("fp").alias("a"), F.col("head").alias("b"))
    near = links(heads.select(F.col("simhash").alias("fp"))).distinct()
    for end in ("a", "b"):
        near = written(near, "anchored")
        near = meet(near, heads.select(F.col("simhash").alias(end), "head"), end).drop(end).withColumnRenamed("head", end)
    return same.where("a <> b").unionByName(near)


def _banded(batches):
    """A row (key, fp, the sketch's halves) for each band."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        words = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(len(fp), 2 + BANDS)
        for at in range(0, len(fp), 4096):
            some = words[at : at + 4096]
            columns = [some[:, 2:].reshape(-1), *(np.repeat(x, BANDS) for x in (fp[at : at + 4096], some[:, 0], some[:, 1]))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "fp", "s", "t"])


def _groups(batches, most=None):
    """The columns of runs of whole groups of sorted rows; a group is what has one value in the first column.

    With ``most``, a group of more rows than that comes in pieces by itself, only the last of which may be shorter.
    """
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if held and held[-1].column(0)[-1].as_py() == key[-1]:
            held.append(batch)  # still the group that was open
            if most is not None and sum(b.num_rows for b in held) > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            continue
        cut = int((key != key[-1]).sum())
        held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(batches, most):
    """Links that connect, within each key, what differs in few bits; of a key with more than ``most`` rows that fill batches, all."""
    import numpy as np
    import pyarrow as pa

    crowd = None
    for table in _groups(batches, most):
        key, fp, s, t = (table.column(i).to_numpy() for i in range(4))
        if not len(key):
            continue
        if key[0] == key[-1] and len(key) > most and (crowd is None or crowd[0] != key[0]):
            crowd = key[0], fp[0]
        if crowd is not None and key[0] == crowd[0]:
            own = key == crowd[0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(np.full(own.sum(), crowd[1]))], ["a", "b"])
            key, fp, s, t = (x[~own] for x in (key, fp, s, t))
            if not len(key):
                continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        first = np.repeat(starts, sizes)
        bits = np.stack([s, t]).view(np.uint64)
        near = np.bitwise_count(bits ^ bits[:, first]).sum(axis=0) <= APART
        alike = near & (first != np.arange(len(key)))
        a, b = [fp[alike]], [fp[first[alike]]]
        for g in np.flatnonzero(~np.logical_and.reduceat(near, starts)):
            mine = np.arange(starts[g], starts[g] + sizes[g])
            reached, left = list(mine[near[mine]]), mine[~near[mine]]
            at = 1  # the first has met all
            while len(left):
                if at == len(reached):
                    reached.append(left[0])
                    left = left[1:]
                hit = np.bitwise_count(bits[:, left] ^ bits[:, reached[at], None]).sum(axis=0) <= APART
                a.append(fp[left[hit]])
                b.append(np.full(hit.sum(), fp[reached[at]]))
                reached.extend(left[hit])
                left, at = left[~hit], at + 1
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def classes(sets: list, similarity: tuple[int, int] = SIMILARITY, known: list[int] | None = None, sides: list | None = None) -> list[int]:
    """For each of the sorted arrays of distinct hashes the place of its class: those similar enough, also through others.

    ``known``: for each the place of one that it is linked with already.  ``sides``: sets of the same side aren't compared.
    """
    import numpy as np

    up, down = similarity
    parent = list(range(len(sets))) if known is None else list(known)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    hashes, back, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(hashes))
    ranks = np.split(rank[back], np.cumsum([len(x) for x in sets])[:-1])
    index: dict[int, list[list[int]]] = {}
    for me in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        n = len(sets[me])
        # two sets that are similar enough share one of the rarest n - ceil(n * similarity) + 1 of each
        rare = np.sort(ranks[me])[: n + (-n * up) // down + 1].tolist()
        met = set()
        for token in rare:
            for members in index.get(token, ()):
                if root(members[0]) == root(me):
                    continue
                for other in members:
                    if other in met or len(sets[other]) * down < n * up or (sides is not None and sides[other] == sides[me]):
                        continue
                    met.add(other)
                    both = len(np.intersect1d(sets[me], sets[other], assume_unique=True))
                    if both * down >= (n + len(sets[other]) - both) * up:
                        parent[root(other)] = root(me)
                        break
        for token in rare:
            lists = index.setdefault(token, [])
            for members in lists:
                if root(members[0]) == root(me):
                    members.append(me)
                    break
            else:
                lists.append([me])
    return [root(i) for i in range(len(sets))]


def _met(rows: DataFrame, near: DataFrame) -> DataFrame:
    """The ``rows`` whose fp is in ``near(node)``, and few others, so that not all sets travel: by a bitmap of at most ``BITS`` bits."""
    bits = min(BITS, 1 << max(15, (16 * near.count()).bit_length()))
    place = F.pmod(F.col("node"), F.lit(bits)).alias("place")
    table = near.select(place).groupBy(F.expr("place div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("place % 32768")).alias("bits"))
    at = rows.withColumn("place", F.pmod(F.col("fp"), F.lit(bits))).withColumn("part", F.expr("place div 32768"))
    byte = "cast(conv(hex(substring(bits, cast(place % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    return at.join(F.broadcast(table), "part").where(F.expr(f"shiftright({byte}, cast(place % 8 as int)) & 1 = 1")).select(*rows.columns)


def _compared(batches, similarity):
    """``(fp, root)`` of what is linked, from sorted rows (class of candidates, fp, hashes)."""
    import numpy as np
    import pyarrow as pa

    for table in _groups(batches):
        key, fp = (table.column(i).to_numpy() for i in range(2))
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in table.column(2).slice(s, e - s).to_pylist()]
            got = np.array(classes(sets, similarity))
            least = np.full(e - s, np.iinfo(np.int64).max)
            np.minimum.at(least, got, fp[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(fp[s:e]), pa.array(least[got])], ["fp", "root"])


def _crossed(batches, similarity):
    """Links ``(a, b)`` of roots, from sorted rows (part, side, root, hashes): sets of both sides of a part are compared."""
    import numpy as np
    import pyarrow as pa

    for table in _groups(batches):
        part, side, label = (table.column(i).to_numpy() for i in range(3))
        if not len(part):
            continue
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            sets = [np.frombuffer(x, np.uint64) for x in table.column(3).slice(s, e - s).to_pylist()]
            _, place, which = np.unique(label[s:e], return_index=True, return_inverse=True)
            got = np.array(classes(sets, similarity, place[which].tolist(), side[s:e].tolist()))
            pairs = np.unique(np.stack([label[s:e], label[s:e][got]], 1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _rejoined(state: DataFrame, here: DataFrame, there: DataFrame, similarity) -> DataFrame:
    """``state`` with the roots that come of comparing, part by part, the sets of ``here`` with those of ``there``."""
    rows = here.select("part", F.lit(0).alias("side"), "root", "hashes").unionByName(there.select("part", F.lit(1).alias("side"), "root", "hashes"))
    links = rows.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _crossed(b, similarity), "a long, b long")
    merged = components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(meet(state, merged, "root", "left").withColumn("root", F.coalesce("to", "root")).select(*state.columns), "crowded")


def _linked(whole: DataFrame, crowded: bool, similarity) -> DataFrame:
    """``(fp, root)`` of what is linked, from ``whole(near, parts, fp, hashes)``: its class of candidates and how many blocks that has."""
    whole = whole.withColumn("block", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int"))
    at = F.xxhash64("near", "block").alias("part")
    one = whole.select(at, "fp", "hashes").repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _compared(b, similarity), "fp long, root long")
    if not crowded:
        return one
    one = written(one, "linked")
    state = written(whole.where("parts > 1").join(one, "fp"), "crowded")
    pivot = state.where("block = 0").withColumn("block", F.explode(F.expr("sequence(1, cast(parts as int) - 1)")))
    state = _rejoined(state, pivot.withColumn("part", at), state.where("block > 0").withColumn("part", at), similarity)
    # the largest class of each class of candidates needs no comparison in itself
    main = written(state.groupBy("near", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("near").agg(F.max_by("root", F.struct("n", "root")).alias("main")), "main")
    rest = written(meet(state, main, "near").where("root <> main").drop("main"), "rest")
    runs = rest.groupBy("near").agg(F.ceil(F.sum(F.octet_length("hashes")) / CLASS_BYTES).cast("int").alias("runs"))
    runs = written(runs, "runs")
    at = F.xxhash64("near", "run", "block").alias("part")
    mine = meet(rest, runs, "near").withColumn("run", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("runs")).cast("int"))
    here = mine.withColumn("block", F.explode(F.expr("sequence(0, cast(parts as int) - 1)"))).withColumn("part", at)
    there = meet(state, runs, "near").withColumn("run", F.explode(F.expr("sequence(0, runs - 1)"))).withColumn("part", at)
    state = _rejoined(state, here, there, similarity)
    return one.join(state.select("fp"), "fp", "left_anti").unionByName(state.select("fp", "root"))


def without_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """The rows of ``docs``, with their columns, of which one stays of each class of similar texts: that of the smallest id.

    Words are those of ``simhash.fingerprints``; a text of fewer words than a
    shingle has is one shingle, and wordless texts are copies of each other.
    ``similarity``, at least 0.8, is that of the sets of shingles.  Repeated and
    null ids as in ``simhash.without_near_duplicates``.
    """
    if similarity[0] * SIMILARITY[1] < SIMILARITY[0] * similarity[1]:
        raise ValueError("the bands serve similarities from 0.8")
    rows = written(marks(docs, id_col, text_col, shingle, whole=True), "shingles")
    least = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.first("sketch").alias("sketch"), F.first("simhash").alias("simhash"), F.max(F.octet_length("hashes")).alias("bytes")), "distinct")
    anchored = _anchored(least.where("sketch is not null").select("simhash", "fp"))
    banded = least.where("sketch is not null").select("fp", "sketch").mapInArrow(_banded, "key long, fp long, s long, t long")
    most = KEY_ROWS
    banded = banded.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _candidates(b, most), "a long, b long")
    near = components(anchored.unionByName(banded))
    size = near.join(least.select(F.col("fp").alias("node"), "bytes"), "node").groupBy("root").agg(F.sum("bytes").alias("bytes"))
    crowds = written(size.where(F.col("bytes") > CLASS_BYTES).select("root", F.ceil(F.col("bytes") / CLASS_BYTES).alias("parts")), "crowds")
    crowded = crowds.limit(1).count() > 0
    homes = meet(near, crowds, "root", "left") if crowded else near.withColumn("parts", F.lit(None).cast("long"))
    homes = homes.select(F.col("node").alias("fp"), F.col("root").alias("near"), F.coalesce("parts", F.lit(1)).alias("parts"))
    # copies are one row before anything is brought together
    sets = _met(rows.select("fp", "hashes"), near).groupBy("fp").agg(F.first("hashes").alias("hashes"))
    linked = _linked(sets.join(homes, "fp"), crowded, similarity)
    roots = written(least.select("fp", "least").join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    smallest = roots.groupBy("root").agg(F.min("least").alias("component"))
    owner = meet(roots, smallest, "root").select("fp", "root", "component")
    return survivors(docs, rows.select("id", "fp"), owner, lambda d, i, t, carry: marks(d, i, t, shingle, carry), id_col, text_col)
