"""The pipeline, stage by stage against what each promises, and the queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from hitweave.llm import pii, queries

from .test_decontaminate import brute as windows
from .test_mixing import draw


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage was given and what it made."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        out[name] = (docs, made)
        docs = pipeline.written(made, f"test-{name}")
        out[name] = (out[name][0], docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages, spark, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    assert all(stages[n][1].columns == want for n, _ in pipeline.STAGES[:-1])


def test_toxic_documents_go(stages, spark, sf_dir):
    before, after = map(rows, stages["toxicity"])
    score = {r.doc_id: r.score for r in queries.op2_toxicity_noisy_or(spark, sf_dir).collect()}
    assert set(after) == {i for i in before if score[i] < 0.5} and all(after[i] == before[i] for i in after)


def test_one_of_each_class_stays(stages):
    """Classes of texts that share 0.8 or more of their five-word shingles, by all pairs."""
    before, after = map(rows, stages["near_duplicates"])
    sets, parent = {}, {i: i for i in before}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, r in sorted(before.items()):
        words = (r.text or "").encode().lower().split()
        mine = frozenset(tuple(words[n : n + 5]) for n in range(max(1, len(words) - 4))) if words else frozenset()
        for j, theirs in sets.items():
            both = len(mine & theirs)
            if mine == theirs or both * 5 >= (len(mine) + len(theirs) - both) * 4 > 0:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        sets[i] = mine
    assert set(after) == {root(i) for i in before} and all(after[i] == before[i] for i in after)


def test_contaminated_go(stages, spark, sf_dir):
    before, after = map(rows, stages["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(after) == {i for i, r in before.items() if not windows(r.text, items)[1]}


def test_values_are_replaced(stages):
    before, after = map(rows, stages["pii"])
    assert set(before) == set(after)
    for i, r in before.items():
        want = pii.pseudonymise(r.text, queries.PII_KEY)[0] if r.text is not None else None
        assert after[i].text == want and after[i].n_chars == (None if want is None else len(want)) and after[i].lang == r.lang


def test_copies(stages):
    before, after = stages["mixing"]
    rate, n = {}, {}
    for r in after.collect():
        rate[r.source] = r.rate
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    for i, r in rows(before).items():
        if r.source in rate:
            assert n.get(i, 0) == draw(0, i, rate[r.source])


def test_run_is_the_stages(stages, spark, sf_dir):
    names = stages["mixing"][1].columns
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).select(names).collect()), key=str) == sorted(map(tuple, stages["mixing"][1].collect()), key=str)


ODD = [(1, "Some text of a few words here", "en", "a", 29, 1), (1, "Some text of a few words here", "en", "a", 29, 1), (None, None, None, None, None, None), (2, "", "en", None, 0, 2), (3, "w " * 60_000, "de", "b", 120_000, 3)]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_stand_odd_rows(spark, sf_dir, name, stage):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for docs in (df, df.limit(0), df.withColumnRenamed("score", "fp"), df.withColumnRenamed("score", "_gone").withColumn("id", F.lit(1)).withColumn("rate", F.lit(2))):
        got = stage(spark, docs, sf_dir)
        assert set(docs.columns) <= set(got.columns)
        assert got.count() <= 5 or name == "mixing"


def test_sql_of_the_queries(spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS FROM read_parquet('{sf_dir}/{t}.parquet')")

    def norm(v):
        return f"{v:.9g}" if isinstance(v, float) else v

    for name, sql in queries.ORACLE_SQL.items():
        want = db.execute(sql)
        names = [x[0] for x in want.description]
        got = queries.QUERIES[name](spark, sf_dir)
        assert sorted(names) == sorted(got.columns)
        assert sorted((tuple(map(norm, r)) for r in got.select(names).collect()), key=str) == sorted((tuple(map(norm, r)) for r in want.fetchall()), key=str), name


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
