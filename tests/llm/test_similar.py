"""Jaccard near-duplicates against all pairs."""

import itertools
import random

import pytest

import corpus_pipeline as pipeline
from hitweave.llm import similar


def grams(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(docs):
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, grams(t)) for i, t in docs]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if alike(a, b):
            low, high = sorted((root(i), root(j)))
            parent[high] = low
    return {i for i in parent if root(i) == i}


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def texts(seed):
    rng, out = random.Random(seed), []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
        out += [base, *(edited(rng, base, n) for n in (1, 3, 5, 6, 7, 9, 15))]
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_finds_texts_edited_to_four_fifths(spark, sf_dir):
    docs = texts(7)
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf_dir).collect()}
    assert got == brute_kept(docs)


@pytest.mark.parametrize("crowd", [1, 40])
def test_classes_cut_into_blocks(spark, monkeypatch, crowd):
    """Blocks of some ten texts and bands of a few rows: chains whose links lie in different blocks, and texts beside the largest class."""
    rng, docs = random.Random(crowd), []
    for _ in range(crowd):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
        docs += [edited(rng, base, rng.choice((0, 1, 2, 4, 6, 8, 12))) for _ in range(240 // crowd)]
        for n in range(60 // crowd):  # a chain away from the base
            base = edited(rng, base, 4)
            docs.append(base)
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    monkeypatch.setattr(similar, "CLASS_BYTES", 16_000 if crowd == 1 else 4_000)
    monkeypatch.setattr(similar, "KEY_ROWS", 20 if crowd == 1 else 3)
    got = {r.doc_id for r in similar.without_similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_kept(docs)


def test_anchors_of_simhashes_make_candidates(spark, sf_dir, monkeypatch):
    """Without the bands the stage still compares all that the SimHashes' anchors bring together: four bits of 64 at most, also through others."""
    import xxhash

    docs = texts(11)
    docs += [(len(docs) + n, f"{t} tail{n}") for n, t in docs[:60]] + [(len(docs) + 60, docs[0][1].upper()), (len(docs) + 61, None), (len(docs) + 62, " ")]

    def bits(text):
        hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams(text)]
        return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))

    prints, homes = {i: bits(t) for i, t in docs}, {i: {i} for i, _ in docs}
    for i, j in itertools.combinations(prints, 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 and homes[i] is not homes[j]:
            homes[i] |= homes[j]
            for k in homes[j]:
                homes[k] = homes[i]
    every = dict(docs)
    want = set().union(*(brute_kept([(i, every[i]) for i in sorted(h)]) for h in {min(h): h for h in homes.values()}.values()))
    wordless = {i for i, t in docs if not (t or "").split()}
    want = want - wordless | {min(wordless)}  # these are copies, without sketches
    assert len(set(prints.values())) < len({frozenset(grams(t)) for _, t in docs})  # different sets of one SimHash
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(similar, "_banded", lambda batches: (b for b in batches if b is None))
    got = {r.doc_id for r in pipeline.drop_near_duplicates(spark, df, sf_dir).collect()}
    assert got == want and len(brute_kept(docs)) < len(want) < len(docs)
    monkeypatch.undo()
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, df, sf_dir).collect()} == brute_kept(docs) - wordless | {min(wordless)}


def test_groups_in_pieces():
    """A key of many rows comes in pieces, and all its rows are linked with one."""
    import numpy as np
    import pyarrow as pa

    key = np.repeat([1, 2, 3, 4], [3, 50, 2, 40])
    fp, bits = np.arange(len(key)), np.random.default_rng(1).integers(0, 1 << 62, (2, len(key)))
    for step in (1, 4, 7):  # in a single batch nothing is held back, and the sketches decide
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (key, fp, *bits)], ["key", "fp", "s", "t"]) for i in range(0, len(key), step)]
        links = [(a, b) for t in similar._candidates(iter(batches), 10) for a, b in zip(*(c.to_pylist() for c in t.columns))]
        for k in (2, 4):
            own = set(fp[key == k].tolist())
            assert {a for a, b in links if b == min(own)} | {min(own)} == own


def test_tables_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [r.doc_id for r in similar.without_similar(docs).collect()]
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got) == sorted(want)


def test_one_stays_of_each_class(spark):
    rows = [(5, "a b c d e f", 1), (2, "A B C D E f", 2), (2, "a B C D E f", 3), (9, None, 3), (7, "", 4), (None, "q w e r t", 5), (None, "q w e r t", 6), (1, "z y x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r.doc_id, r.text) for r in similar.without_similar(df).where("doc_id is not null").collect())
    assert got == [(1, "z y x"), (2, "A B C D E f"), (7, "")]
    assert similar.without_similar(df).count() == 4 and similar.without_similar(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        similar.without_similar(df, similarity=(7, 10))
