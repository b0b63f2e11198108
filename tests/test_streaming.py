"""Growing stores and streams."""

import json

import pytest
from pyspark.sql import functions as F

from hitweave.collection import extents, records
from hitweave.plans import Engine
from hitweave.streaming import upserts
from hitweave.streaming.ingest import activity, files, ingest
from hitweave.streaming.store import Store


def batch(spark, rows):
    df = spark.createDataFrame(rows, "i long, k string, t string")
    recs = records(df, "i", "t", key="k")
    return recs, extents(df, "all", rec_id="i", f_start=F.lit(0), f_end=F.char_length("t") - 1, txt="t")


def found(store, q):
    return sorted(r.rec_id for r in Engine(store.collection()).compile(q).collect())


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.live().count() == 0
    store.append(0, *batch(spark, [(1, "a", "alpha beta"), (2, "b", "beta"), (3, "c", "gamma")]))
    store.append(1, *batch(spark, [(4, "a", "delta"), (5, "d", "beta delta"), (6, "d", "beta epsilon")]))
    assert {r.key: r.rec_id for r in store.live().collect()} == {"a": 4, "b": 2, "c": 3, "d": 6}
    assert found(store, "beta") == [2, 6] and found(store, "alpha") == [] and found(store, "all/delta") == [4]
    store.delete(2, spark.createDataFrame([("b",), ("zz",)], "key string"))
    assert found(store, "beta") == [6]
    store.delete(3, spark.createDataFrame([("b",)], "key string"), restore=True)
    assert found(store, "beta") == [2, 6]
    store.delete(4, spark.createDataFrame([("c",)], "key string"))
    store.append(5, *batch(spark, [(7, "c", "gamma again")]))
    assert found(store, "gamma") == [7]
    store.append(5, *batch(spark, [(7, "c", "gamma again")]))  # repeated, as after a restart
    assert found(store, "gamma") == [7]
    small = store.compact(str(tmp_path / "small"))
    assert small.live().count() == store.live().count() == 4 and found(small, "beta") == [2, 6] and found(small, "all/epsilon") == [6]


def test_expiry(spark):
    df = spark.sql("SELECT 1 AS i, timestamp'2024-01-01 00:00:00.5' AS ts, 60 AS ttl UNION ALL SELECT 2, timestamp'2024-01-01', CAST(NULL AS INT) UNION ALL SELECT 3, timestamp'2024-01-01', 10")
    now = F.lit("2024-01-01 00:30:00").cast("timestamp")
    assert sorted(r.i for r in upserts.alive(df, "ts", F.col("ttl"), now).collect()) == [1, 2]
    recs = records(df.withColumn("t", F.lit("x")), "i", "t", date_expires=F.expr("ts + make_interval(0, 0, 0, 0, 0, ttl)"))
    assert sorted(r.rec_id for r in upserts.not_expired(recs, now).collect()) == [1, 2]


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, None), (None, 1, "n"), (None, 2, "m"), ("b", 1, None)], "key string, seq int, v string")
    assert sorted(((r.key, r.v) for r in upserts.newest(df, "key", "seq").collect()), key=str) == sorted([("a", "y"), (None, "n"), (None, "m"), ("b", None)], key=str)
    gone = spark.createDataFrame([("a",), (None,)], "key string")
    assert sorted((r.key for r in upserts.without_deleted(df, gone).collect()), key=str) == sorted([None, None, "b"], key=str)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "store"))

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
        q = ingest(files(spark, str(tmp_path / "in")), store, str(tmp_path / "checkpoint"))
        assert q.awaitTermination(120)
        assert q.exception() is None

    put("1.json", [{"id": "a", "t": "alpha beta"}, {"id": "b", "t": "beta"}])
    assert len(found(store, "beta")) == 2 and len(found(store, "t/alpha")) == 1
    put("2.json", [{"index": {"_id": "a"}}, {"id": "a", "t": "gamma"}, {"delete": {"_id": "b"}}])
    assert len(found(store, "beta")) == 0 and len(found(store, "gamma")) == 1
    assert {r.key for r in store.live().collect()} == {"a"}


def test_activity(spark, sf_dir, tmp_path):
    """Windowed counts of a stream are those of the table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = activity(stream, "ts", ["event_type"], "6 hours", value=F.col("value")).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in spark.table("activity").collect()}
    want = events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert got == {(r.w.start, r.event_type): (r.n, round(r.total, 6)) for r in want.collect()}


def test_store_without_extents(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), stopwords=frozenset({"beta"}))
    store.append(0, batch(spark, [(1, "a", "alpha beta")])[0])
    assert found(store, "beta") == [] and found(store, "alpha") == [1]
    with pytest.raises(AttributeError):
        store.nothing
