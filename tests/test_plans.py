"""What the plans read: filters and columns reach the scan, and no step needs all pairs."""

import re

import pytest
from pyspark.sql import functions as F

from hitweave import queries as engine
from hitweave.operators import terms
from hitweave.plans import Engine


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def scans(df, column):
    """The scans of the index that read a column."""
    return [x for x in re.findall(r"FileScan parquet \[[^\n]*", plan(df)) if re.search(rf"[\[,]{column}#", x)]


@pytest.fixture(autouse=True)
def whole_plans(spark):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.set("spark.sql.maxMetadataStringLength", before)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return engine.documents(spark, sf_dir)


def test_words_are_pushed_to_the_index(docs):
    for text, filter_ in (("that", "EqualTo(term,that)"), ("ther*", "StringStartsWith(term,ther)"), ('"of the"', "In(term, [of,the])")):
        found = scans(Engine(docs, model="none").compile(text), "term")
        assert found and all(filter_ in x for x in found), text


def test_words_of_a_glob_are_asked_for_by_name(docs, monkeypatch):
    """The vocabulary gives the words; where they are too many, the index is filtered, with the same result."""
    for find, part, filter_ in ((terms.suffix, "tion", "StringEndsWith(term,tion)"), (terms.containing, "ment", "StringContains(term,ment)"), (terms.suffix, "ing", "StringEndsWith(term,ing)")):
        named = find(docs, part)
        found = scans(named, "term")
        words = [r.term for r in docs.vocabulary().where(F.col("term").endswith(part) if find is terms.suffix else F.col("term").contains(part)).collect()]
        if words:
            assert found and all(re.search(r"(In|EqualTo)\(term", x) and filter_ not in x for x in found), part
        monkeypatch.setattr(terms, "NAMED", 0)
        filtered = find(docs, part)
        if words:
            assert all(filter_ in x for x in scans(filtered, "term")), part
        keep = ("rec_id", "hit_count")
        assert sorted(named.select(*keep).collect()) == sorted(filtered.select(*keep).collect())
        monkeypatch.undo()


def test_scores_read_no_texts(spark, sf_dir):
    for name in ("bm25_top", "score_bm25", "sort_date", "op_not", "op_peer", "red_reduce", "vocabulary"):
        if name in engine.QUERIES:
            assert not scans(engine.QUERIES[name](spark, sf_dir), "text"), name


def test_containers_are_found_once_for_each_hit(spark, sf_dir):
    """The smallest extent is taken below the tests of pairs, once for each side."""
    p = plan(engine.QUERIES["op_peer"](spark, sf_dir)).split("\n\n")[0]
    assert p.count("array_min") == 2
    assert not any("exists(" in x for x in p.splitlines() if "array_min" in x)


def test_places_are_read_only_where_asked_for(docs):
    keep = ("rec_id", "score", "hit_count", "aux_count")
    for text in ("that from AND", "that from OR", "that from ANDNOT", "that from MAYBE", "ther* NOT", "that REDUCE:1", "that BOOST:2"):
        assert not scans(Engine(docs).compile(text).select(*keep), "hits"), text
    assert scans(Engine(docs).compile("that from NEAR").select(*keep), "hits")


def test_fields_are_pushed_to_the_extents(spark, sf_dir):
    c = engine.orders(spark, sf_dir)
    e = Engine(c, model="none", types=engine._TYPES)
    found = scans(e.compile("price>100000"), "field")
    assert found and all("EqualTo(field,price)" in x and "GreaterThan(num,100000.0)" in x for x in found)
    found = scans(e.compile("day>=1999"), "field")
    assert found and all("EqualTo(field,day)" in x for x in found)


def test_no_pairs_of_all_rows(spark, sf_dir):
    """Nested loops are with a broadcast row of aggregates only, and nothing is a Cartesian product."""
    for name in ("op_and", "op_or", "op_not", "op_peer", "prox_near", "op_maybe", "score_bm25", "f_within", "red_reduce0", "op_join_key", "q_rpn", "facet_search", "sort_newsrank"):
        p = plan(engine.QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in p, name
        assert not re.search(r"Window .*\[\], \[", p), name


def test_repeated_leaves_are_planned_once(docs):
    e = Engine(docs)
    e.compile("that from AND that OR")
    assert len(e._leaves) == 2


def test_top_k_is_not_a_full_sort(spark, sf_dir):
    p = plan(engine.topk(spark, sf_dir))
    assert "TakeOrderedAndProject" in p
