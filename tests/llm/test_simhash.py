"""SimHash near-duplicates against all pairs."""

import itertools
import random

import xxhash

from hitweave.llm import simhash
from hitweave.llm.queries import op3_simhash_anchor_dedup


def brute_fingerprint(text, n=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids_and_fps, threshold=4):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    fps = sorted({f for _, f in ids_and_fps})
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= threshold:
            parent[root(a)] = root(b)
    least = {}
    for i, f in ids_and_fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {(i, f): least.get(root(f)) for i, f in ids_and_fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_design_covers_every_spread():
    for spread in itertools.product(range(5), repeat=6):
        if sum(spread) == 4:
            assert any(sum(spread[b] for b in t) <= 1 for t in simhash.TRIPLES)
    for t in simhash.TRIPLES:
        assert sum(simhash.BLOCKS[b + 1] - simhash.BLOCKS[b] for b in t) >= 31


def _linked(spark, fps, **options):
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in simhash.links(df, **options).collect():
        parent[root(r.a)] = root(r.b)
    return {f: root(signed(f)) for f in fps}


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for bit in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << bit
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, 0xF, 0x1F}
    want = brute_classes([(n, f) for n, f in enumerate(sorted(fps))])
    for homes in (4096, 2):  # 2: nearly all anchors are cut into blocks
        got = _linked(spark, fps, homes=homes)
        pairs = {}
        for (_, f), c in want.items():
            pairs.setdefault(c, set()).add(got[f])
        assert all(len(x) == 1 for x in pairs.values()) and len({next(iter(x)) for x in pairs.values()}) == len(pairs)


def test_query_against_all_pairs(spark, sf_dir):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_classes(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_anchor_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", want[i, f]) for i, f in docs}


def test_edges(spark):
    long = "word " * 100_000
    rows = [(5, "a b c d e", 1), (2, "A B\tC\nD e", 2), (9, None, 3), (7, "", 4), (8, " \t\r\n\x0b\x0c", 5), (4, "one", 6), (4, "one", 6), (None, "one", 7), (6, long, 8), (3, "é ß ı", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r.id if r.id is not None else -1, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(df).collect())
    want = brute_classes([(i, brute_fingerprint(t)) for i, t, _ in rows])
    assert got == sorted((i if i is not None else -1, brute_fingerprint(t), want[i, brute_fingerprint(t)]) for i, t, _ in rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert {c for i, _, c in got if i in (7, 8, 9)} == {7}


def test_one_stays_of_each_class(spark):
    rows = [(5, "a b c d e", 1), (2, "A B C D E", 2), (2, "a B C D E", 3), (9, None, 3), (7, "", 4), (None, "q w e r t", 5), (None, "q w e r t", 6), (1, "z y x w v", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = sorted(((r.doc_id, r.text, r.id) for r in simhash.without_near_duplicates(df).collect()), key=str)
    assert [(i, t) for i, t, _ in got if i is not None] == [(1, "z y x w v"), (2, "A B C D E"), (7, "")]
    assert sum(i is None for i, _, _ in got) == 1
    clean = df.where("doc_id in (1, 5, 9)")
    assert simhash.without_near_duplicates(clean).count() == 3 and simhash.without_near_duplicates(df.limit(0)).count() == 0
