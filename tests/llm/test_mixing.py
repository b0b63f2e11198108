"""Poisson replication: an inversion in plain Python, and the weights on average."""

import hashlib
import math

from hitweave.llm import mixing
from hitweave.llm.queries import op8_poisson_mixing


def draw(seed, ident, rate):
    """A mean above 16 is the sum of draws of equal means up to it."""
    parts = max(1, math.ceil(rate / 16))
    total, rate = 0, rate / parts
    for k in range(1, parts + 1):
        given = f"{seed}:{ident}" if parts == 1 else f"{seed}/part:{ident}:{k}"
        u = int(hashlib.md5(given.encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        n = 0
        while c <= u and n < 100:
            n += 1
            p *= rate / n
            c += p
        total += n
    return total


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    size = {}
    for d in docs:
        size[d.source] = size.get(d.source, 0) + len((d.text or "").encode())
    whole = sum(v**0.5 for v in size.values())
    rate = {s: v**0.5 / whole * sum(size.values()) / v if v else 1.0 for s, v in size.items()}
    rows = op8_poisson_mixing(spark, sf_dir).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.copy)
        assert abs(r.rate - rate[r.source]) < 1e-9
    assert {k: sorted(v) for k, v in got.items()} == {d.doc_id: list(range(1, n + 1)) for d in docs if (n := draw(0, d.doc_id, rate[d.source]))}
    assert len({r.shuffle_key for r in rows}) == len(rows)


def test_weights_are_reached_on_average(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 10 = 0, 'small', 'big') as source", "'some text' as text")
    got = {r.source: r["count"] for r in mixing.mix(df, {"small": 0.5, "big": 0.5}).groupBy("source").count().collect()}
    assert abs(got["small"] - 10_000) < 500 and abs(got["big"] - 10_000) < 500
    assert {r.source for r in mixing.mix(df, {"small": 1.0}).select("source").distinct().collect()} == {"small"}
    assert mixing.mix(df, {"small": 0.5, "big": 0.5}, seed=1).count() != sum(got.values())


def test_edges(spark):
    rows = [(1, "a", "x", 9), (1, "a", "x", 9), (None, None, None, 9), (2, "b", "", 9), (3, None, "some", 9), (4, "c", "y" * 100_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int")
    out = mixing.mix(df, size=1e6)
    assert out.columns == ["doc_id", "source", "text", "copy", "copy_", "rate", "shuffle_key"]
    got = out.collect()
    assert all(r.copy_ >= 1 and r.copy == 9 for r in got)
    assert mixing.mix(df, suffix="_mix").columns[4:] == ["copy_mix", "rate_mix", "shuffle_key_mix"]
    assert sum(r.doc_id == 1 for r in got) % 2 == 0
    assert mixing.mix(df.limit(0)).count() == 0
    extra = df.withColumnRenamed("copy", "_own").selectExpr("*", "1 as _n", "2 as ident", "3 as row")
    assert mixing.mix(extra).columns == [*extra.columns, "copy", "rate", "shuffle_key"]
    assert {r._own for r in mixing.mix(extra, size=1e6).collect()} == {9}


def test_small_sources_reach_their_weights(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 100 = 0, 'small', 'big') as source", "'some text' as text")
    rows = mixing.mix(df, {"small": 0.5, "big": 0.5}).select("doc_id", "source", "copy", "rate").collect()
    n = {}
    for r in rows:
        if r.source == "small":
            n.setdefault(r.doc_id, []).append(r.copy)
            assert abs(r.rate - 50) < 1e-9
    assert abs(sum(map(len, n.values())) - 10_000) < 500 and abs(len(rows) - 20_000) < 800
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in n.values())
    spread = sum((len(v) - 50) ** 2 for v in n.values()) / len(n)
    assert len(n) == 200 and 30 < spread < 75  # that of a Poisson distribution, its mean


def test_very_many_copies_of_one(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y" * 1000)], "doc_id long, source string, text string")
    got = mixing.mix(df, {"a": 1.0}, size=200_000).groupBy().agg({"copy": "max", "*": "count"}).first()
    assert got["max(copy)"] == got["count(1)"] and abs(got["count(1)"] - 200_000) < 3000
