"""Exact top-k search against all inner products."""

import math
import random

import numpy as np
import pytest

from hitweave.llm import topk
from hitweave.llm.queries import op10_topk_impact_ordered
from pyspark.sql import functions as F


def brute(rows, is_query, k=5):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in fine:
        if is_query(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
            out[i] = [(n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("shard,block", [(16_384, 1_024), (40, 7)])
def test_random(spark, shard, block):
    rng = random.Random(8)
    rows = [(n, [rng.gauss(0, 1) for _ in range(8)]) for n in range(300)]
    rows += [(300 + n, [float(rng.randint(0, 1)) for _ in range(8)]) for n in range(100)]  # many ties
    rows += [(401, None), (402, [None] * 8), (403, [math.nan] * 8), (404, [math.inf] * 8), (405, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(topk.search(df, F.col("vec_id") % 5 == 0, shard=shard, block=block)) == brute(rows, lambda i: i % 5 == 0)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(op10_topk_impact_ordered(spark, sf_dir)) == brute(rows, lambda i: i % 50 == 0)


def test_stops_on_proof_and_still_right():
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(4000, 16)) ** 3 * 64).astype(np.int64)
    shard = topk.Shard(np.arange(4000), v)
    few = 0
    for q in range(40):
        rows = shard.members(v[q], 6)
        few += len(rows) < 1000
        s = v @ v[q]
        order = np.lexsort((np.arange(4000), -s))
        order = order[order != q][:5]
        assert shard.best(v[q].tolist(), 5, q) == list(zip(s[order].tolist(), order.tolist()))
    assert few > 20


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, score int, rank int, vector int"
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 1, 1), (50, [2.0], 1, 1, 1), (1, [-1.0, 0.5], 1, 1, 1)], schema)
    got = found(topk.search(df, F.col("vec_id") % 50 == 0))
    assert got[0] == [(1, 50, 131072), (2, 1, 0)] and len(got[50]) == 2
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(n, [1.0], 1, 1, 1) for n in range(20)], schema)
    assert found(topk.search(same, F.col("vec_id") == 3))[3] == [(n + 1, i, 65536) for n, i in enumerate((0, 1, 2, 4, 5))]


def test_components_of_any_size(spark):
    rng = random.Random(3)
    sizes = [0.5, 3e5, 6e5, 7e5, 1e6, 1e9, 3e15, 1e17, 1e40, 1e300, 5e307]
    rows = [(n, [rng.choice((1, -1)) * rng.choice(sizes) * rng.random() for _ in range(4)]) for n in range(150)]
    rows += [(150, [1.0, 0.0]), (151, [600_000.0]), (152, [700_000.0]), (153, [2.0**55, 2.0**55]), (154, [2.0**55 + 8, 2.0**55])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(topk.search(df, F.col("vec_id") % 50 == 0, shard=40))
    want = {}
    exact = {i: [math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x) for x in v] for i, v in rows}
    for i in range(0, 151, 50):
        best = sorted((-sum(a * b for a, b in zip(exact[i], v)), j) for j, v in exact.items() if j != i)[:5]
        want[i] = [(n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(best, 1)]
    assert got == want
