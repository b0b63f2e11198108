"""Repeated substrings against every window."""

import hashlib
import random

import pytest

from hitweave.llm import substrings
from hitweave.llm.queries import op5_suffix_substring_dedup


def brute(rows, length):
    """(n_bytes, removed, spans, digest) by row number; rows without an id come last and are one document."""
    order = {}
    for n, (i, t) in enumerate(rows):
        order.setdefault((i is None, i if i is not None else 0), []).append(n)
    first = {}
    for key in sorted(order):
        for n in order[key]:
            data = (rows[n][1] or "").encode()
            for s in range(len(data) - length + 1):
                w = data[s : s + length]
                first[w] = min(first.get(w, (key, s)), (key, s))
    out = {}
    for key, ns in order.items():
        for n in ns:
            data = (rows[n][1] or "").encode()
            gone = [False] * len(data)
            for s in range(len(data) - length + 1):
                if first[data[s : s + length]] < (key, s):
                    gone[s : s + length] = [True] * length
            spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
            out[n] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def run(spark, given, **options):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(given)], "n int, doc_id long, text string")
    got = {}
    for r in substrings.repeated_substrings(df, carry=["n"], **options).collect():
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
        got[r.n] = (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), r.kept_sha256)
    return got


@pytest.mark.parametrize("rows_at_a_time", [20_000, 3])
def test_random_texts(spark, rows_at_a_time):
    rng = random.Random(11)
    blocks = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 40))) for _ in range(12)]
    rows = [(rng.choice([n, n, None, 3]), "".join(rng.choice(blocks) for _ in range(rng.randint(0, 6)))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "ab" * 200), (102, "a" * 300), (104, "short")]
    assert run(spark, rows, length=12, rows=rows_at_a_time) == brute(rows, 12)


def test_self_overlap_and_length_one(spark):
    rows = [(1, "aaaaabaaaab"), (0, "baaa"), (2, "xyz")]
    for length in (1, 2, 4):
        assert run(spark, rows, length=length) == brute(rows, length)


def test_query_against_every_window(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(docs, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_suffix_substring_dedup(spark, sf_dir).collect()}
    assert got == {docs[n][0]: v for n, v in want.items()}


def test_planted_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(n, " ".join(word() for _ in range(50)) + " " + passage + " " + " ".join(word() for _ in range(20))) for n in range(5)]
    got = run(spark, rows, length=100)
    assert got[0][1] == 0 and all(got[n][1] >= len(passage) for n in range(1, 5)) and got == brute(rows, 100)


def test_very_long_text(spark):
    rng = random.Random(6)
    part = "".join(chr(97 + rng.getrandbits(4)) for _ in range(50_000))
    rows = [(1, part + part), (2, part[:150])]
    got = run(spark, rows, length=100)
    assert got[0][1] == 50_000 and got[1][1] == 150


def test_a_passage_in_very_many_surroundings(spark):
    """One anchor in 3,000 contexts, split until the buckets are small or one window's copies."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, rows = word(12), []
    for n in range(3000):
        left, right = rng.choice([word(14), "stem of a left"]), rng.choice([word(14), "right hand end"])
        rows.append((n, left + core + right))
    assert run(spark, rows, length=20, rows=100) == brute(rows, 20)


def test_hashes_that_collide_are_not_trusted(monkeypatch):
    import numpy as np

    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    group = np.sort(np.array([rng.randrange(5) for _ in strings]))
    right = substrings._Suffixes(strings).classes(group)
    monkeypatch.setattr(substrings._Suffixes, "common", lambda self, a, b: np.minimum(self.sizes[a], self.sizes[b]))
    wrong = substrings._Suffixes(strings).classes(group)
    assert [(group[i], strings[i]) for i in right[0]] == [(group[i], strings[i]) for i in wrong[0]] and right[1].tolist() == wrong[1].tolist()
    # contexts of equal hashes but other bytes aren't repeats
    import pyarrow as pa

    monkeypatch.setattr(substrings, "_anchors", lambda data, bounds, length, k, powers: (np.array([0, 1, 2]), np.array([2, 22, 42]), np.array([0, 20, 40]), np.array([0, 20, 40]), np.full(3, 5, np.uint64), np.full(3, 7, np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array(["a" * 20, "b" * 20, "a" * 20])], ["id", "row", "text"])
    got = [r for b in substrings._listed([batch], 20, 10) for r in b.to_pylist()]
    assert sorted((r["id"], r["anchor"]) for r in got if r["anchor"] is not None) == [(1, 5), (2, 5)]


def test_long_texts_are_cut(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    monkeypatch.setattr(substrings, "CHUNK", 700)
    seen = {}
    for rows, offsets, data, bounds in substrings._chunks(pa.array([b"", text, b"xyz"]), 20):
        for row, offset, s, e in zip(rows, offsets, bounds, bounds[1:]):
            part = data[s:e].tobytes()
            assert part == (b"", text, b"xyz")[row][offset : offset + e - s]
            for at in range(len(part) - 19):
                seen[row, offset + at] = seen.get((row, offset + at), 0) + 1
    assert seen == {(1, n): 1 for n in range(4981)}


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 30, 5, "r")], "doc_id long, text string, anchor int, row string")
    assert substrings.repeated_substrings(df, length=10, carry=["doc_id", "anchor", "row"]).collect()[0]["row"] == "r"
    assert substrings.repeated_substrings(df.withColumnRenamed("row", "removed"), length=10, carry=["removed"]).columns == ["removed", "n_bytes", "removed_", "kept_sha256"]
    assert substrings.repeated_substrings(df.limit(0), length=10).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_substrings(df, length=10, k=11)
