"""Benchmark decontamination against every window."""

import hashlib
import random
import re

import pytest

from hitweave.llm import decontaminate
from hitweave.llm.queries import op6_benchmark_winnowing


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items, n=10):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        x = words(text)
        size = min(n, len(x))
        windows = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_random(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["a", "b", "é", "C3"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(n, text(rng.randint(0, 60))) for n in range(80)] + [(80, None), (81, ""), (82, "., ;"), (83, "x " * 50_000)]
    items = [(n, text(rng.randint(0, 14))) for n in range(30)] + [(7, "a b"), (None, "b b b b b"), (40, None), (41, ""), (42, "C3, é!")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for n, many, chunk in ((10, 256, 4 << 20), (4, 2, 4 << 20), (10, 256, 300), (3, 256, 4 << 20)):  # also: windows as texts, texts in pieces
        monkeypatch.setattr(decontaminate, "MANY", many)
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        got = {r.doc_id: r for r in decontaminate.contamination(d, b, n=n, carry=["doc_id"]).collect()}
        for i, t in docs:
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute(t, items, n), (n, i)
            spans = [(s.start, s.end) for s in got[i].spans]
            assert spans == sorted(spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and sum(e - s for s, e in spans) == got[i].n_hit


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op6_benchmark_winnowing(spark, sf_dir).collect()}
    for r in docs:
        n, hit, found = brute(r.text, items)
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (n, hit, len(found), hit > 0)
        assert x.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_large_benchmark_and_copies(spark, monkeypatch):
    """A full bitmap lets all through; a hot text and a table of hits that isn't broadcast."""
    from hitweave.llm import _base

    monkeypatch.setattr(decontaminate, "BITS", 1 << 15)
    monkeypatch.setattr(_base, "SMALL", -1)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(40))) for n in range(3000)]
    docs = [(n, " ".join([word(), word(), items[n % 500][1][10:120], word()])) for n in range(500)] + [(1000 + n, "copies " + items[7][1]) for n in range(1500)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, b, carry=["doc_id"]).collect()}
    assert len(got) == 2000
    for i, t in docs[:500:25] + docs[500:502]:
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == brute(t, [items[i % 500], items[7]])
    assert all(got[i].n_hit == 40 and got[i]["items"] == ["7"] for i in range(1000, 2500))


def test_edges(spark):
    d = spark.createDataFrame([(1, "one two three", "keep", 5)] * 2, "doc_id long, text string, spans string, n_words int")
    b = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    rows = decontaminate.contamination(d, b, carry=d.columns, suffix="_x").collect()
    assert [(r.spans, r.n_words, r.n_words_x, r.n_hit_x) for r in rows] == [("keep", 5, 3, 2)] * 2
    assert decontaminate.contamination(d, b.limit(0), carry=["doc_id"]).collect()[0].n_hit == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contamination(d, b, n=1)


def test_long_texts_in_pieces(monkeypatch):
    """Pieces of a text overlap by so many words that no window is lost."""
    rng = random.Random(6)
    text = " ".join(rng.choice(("ab", "é", "C3", "d")) + rng.choice((",", "")) for _ in range(3000)).encode()
    want = [w.encode() for w in words(text.decode())]
    monkeypatch.setattr(decontaminate, "CHUNK", 50)
    seen, last = set(), 0
    for number, some in decontaminate._pieces(text, 9):
        assert some == want[number : number + len(some)] and number <= last
        seen.update(range(number, number + len(some) - 9))
        last = number + len(some) - 9
    assert seen == set(range(len(want) - 9))


def test_words_are_counted_without_expressions(spark, capsys):
    """Java's regular expression over all texts took most of op6's time; the count goes where nobody asks for it."""
    odd = [None, "", " ", ".,;", "a", "a ", " a", "Ab9é z z \x00q\x7fr\n\U0001f600-[x]`{y}", "x " * 70_000 + "é" * 70_000, "@A[Z`a{z/0:9"]
    d, b = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), spark.createDataFrame([(1, "two three")], "item_id long, text string")
    got = decontaminate.contamination(d, b, carry=["doc_id"])
    assert {r.doc_id: r.n_words for r in got.collect()} == {i: len(words(t)) for i, t in enumerate(odd)}
    got.explain()
    whole = capsys.readouterr().out
    got.select("doc_id", "n_hit").explain()
    part = capsys.readouterr().out
    assert "regexp" not in whole.lower() and "_counted" in whole and "_counted" not in part
