"""Queries on tables made for them, against their SQL, and what steps hold at once."""

import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitweave import collection
from hitweave import queries as engine
from hitweave.functions.text import UNICODE_WORD
from hitweave.operators import feedback, terms
from hitweave.sources import html as html_source
from hitweave.sources.markup import parse
from hitweave.storage import written


def against_sql(spark, name, sf_dir, *tables):
    """The rows of a query and of its SQL over tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    want = con.execute(engine.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    return sorted(map(tuple, engine.QUERIES[name](spark, str(sf_dir)).select(*names).collect()), key=str), sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("cut", ["and&amp", "a &quot;b&quot; &#65; &eacute;", "&amp;lt; &lt;b&gt;", "plain"])
def test_titles_with_other_references(spark, tmp_path, cut):
    """A reference that is cut, or isn't among those of the SQL, stays in the title."""
    spark.createDataFrame([(1, f"<html><head><title>{cut}</title></head><body>x</body></html>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = against_sql(spark, "html_title", tmp_path, "pages")
    assert got == want
    assert parse("<p>A &quot;b&quot; &amp</p>")[0].strip() == 'A "b" &'  # as browsers read them, where nothing else is asked for


def words_of(texts):
    """(term, rec_id) with the places and numbers of its hits, by plain Python."""
    out = {}
    for rec, text in texts.items():
        for n, m in enumerate(re.finditer("[a-z0-9]+", collection.lowered(text or ""))):
            out.setdefault((m.group(), rec), []).append((m.start(), m.end() - 1, n))
    return out


TEXTS = {1: "Äöü the cat\nthe", 2: None, 3: "", 4: "cat's THE 99 \U0001f600 the dog İx", 5: "the", 6: "\n a1\n", 7: "zebra " * 50 + "the", 9: "x"}


@pytest.mark.parametrize("run", [1, 40, 8 << 20])
def test_index_is_written_without_a_shuffle(spark, monkeypatch, run):
    """Each task writes the words of its own records, sorted by runs; what else an index has is written when it is asked for."""
    tags = []
    monkeypatch.setattr(collection, "RUN", run)
    monkeypatch.setattr(collection, "written", lambda df, tag, **o: (tags.append((tag, df._jdf.queryExecution().executedPlan().toString())), written(df, tag, **o))[1])
    df = spark.createDataFrame(list(TEXTS.items()), "i long, t string").coalesce(4)
    c = collection.Collection.of(collection.records(df, "i", "t"))
    assert [t for t, _ in tags] == ["postings"] and not any("rangepartitioning" in p or "hashpartitioning" in p for _, p in tags)
    want = words_of(TEXTS)
    assert {(r.term, r.rec_id): [tuple(h) for h in r.hits] for r in c.postings.collect()} == want
    assert all(r.tf == len(want[r.term, r.rec_id]) for r in c.postings.collect())
    assert {r.term: (r.tf, r.df) for r in c.vocabulary().collect()} == {w: (sum(len(h) for (x, _), h in want.items() if x == w), sum(x == w for x, _ in want)) for w, _ in want}
    assert c.statistics().first().n_records == len(TEXTS) and "text" not in c.described().columns
    # the rows of one run are in the order of words
    own = list(collection._posted(iter([pa.RecordBatch.from_arrays([pa.array(list(TEXTS)), pa.array([x or "" for x in TEXTS.values()])], ["i", "t"])]), "[a-z0-9]+", frozenset({"the"})))
    rows = [(t, r) for b in own for t, r in zip(b["term"].to_pylist(), b["rec_id"].to_pylist(), strict=True)]
    assert sorted(rows) == sorted((w, r) for w, r in want if w != "the") and (rows == sorted(rows) or run < 8 << 20)


def test_words_of_any_script(spark):
    """A pattern that could go over the ends of texts is met text by text."""
    df = spark.createDataFrame([(1, "Größe l'an x.de"), (2, "größe")], "i long, t string")
    c = collection.Collection.of(collection.records(df, "i", "t"), pattern=UNICODE_WORD)
    assert {(r.term, r.rec_id): [tuple(h) for h in r.hits] for r in c.postings.collect()} == {("größe", 1): [(0, 4, 0)], ("l'an", 1): [(6, 9, 1)], ("x.de", 1): [(11, 14, 2)], ("größe", 2): [(0, 4, 0)]}


def test_stopwords_need_no_index(spark, sf_dir, monkeypatch):
    """An index isn't made for a query that doesn't read it, and of a collection without one only the words asked for are kept."""
    monkeypatch.setattr(engine, "documents", None)
    assert engine.QUERIES["term_stopword"](spark, sf_dir).count() > 0
    df = spark.createDataFrame(list(TEXTS.items()), "i long, t string")
    c = collection.Collection.of(collection.records(df, "i", "t"), indexed=False, stopwords=["dog"])
    assert {(r.term, r.rec_id) for r in c.posted("the", "x", "dog").collect()} == {("the", 1), ("the", 4), ("the", 5), ("the", 7), ("x", 9)} | {("x", 4)} & set(words_of(TEXTS))


def test_length_is_read_where_it_counts(spark, sf_dir):
    """BM25 without length normalisation meets no table of records."""
    plan = engine.QUERIES["score_bm25_b0"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "rec_len" not in plan
    assert "rec_len" in engine.QUERIES["score_bm25"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_few_words_are_asked_for_by_name(spark, monkeypatch):
    """Feedback by few words moves no postings; with many words the result is the same."""
    df = spark.createDataFrame(list(TEXTS.items()), "i long, t string")
    c = collection.Collection.of(collection.records(df, "i", "t"))
    words = spark.createDataFrame([("the", 2.0), ("dog", 1.0), ("nowhere", 1.0)], "term string, weight double")
    keep = ("rec_id", "score", "hit_count", "aux_count")
    few = feedback.by_words(c, words)
    assert "In(term, [dog,nowhere,the])" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(feedback, "NAMED", 1)
    assert sorted(map(tuple, few.select(*keep).collect())) == sorted(map(tuple, feedback.by_words(c, words).select(*keep).collect())) != []
    assert feedback.by_words(c, words.where("false")).count() == 0


def test_pages_are_parsed_few_at_a_time(spark, tmp_path, monkeypatch):
    """However many pages a batch has, the fields of few are held; what is not asked for isn't made."""
    pages = [(n, f"/{n}", None if n == 7 else "" if n == 8 else f'<html><head><title>t {n}</title></head><body><h1>De {n}</h1><p><a href="/{n}">x</a>' + "<p>y" * n) for n in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[2] for p in pages]), pa.array([p[0] for p in pages])], ["_source", "rec_id"])
    monkeypatch.setattr(html_source, "CHARS", 500)
    out = list(html_source._parsed(iter([batch]), True, "all", ("text", "fields")))
    assert len(out) > 10 and sum(b.num_rows for b in out) == 60 and max(b.num_rows for b in out) < 15
    for b in out:
        for n, text, fields in zip(b["rec_id"].to_pylist(), b["text"].to_pylist(), b["fields"].to_pylist(), strict=True):
            assert (text, [tuple(f.values()) for f in fields]) == parse(pages[n][2] or "")
    assert [b.schema.names for b in html_source._parsed(iter([batch]), True, "all", ("fields",))][0] == ["rec_id", "fields"]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("html_links", "html_headings_search"):
        got, want = against_sql(spark, name, tmp_path, "pages")
        assert [tuple(f"{v:.6f}" if isinstance(v, float) else v for v in r) for r in got] == [tuple(f"{v:.6f}" if isinstance(v, float) else v for v in r) for r in want] != []
    # the pages' other columns come along: no join brings them back to their texts
    recs, _ = html_source.collection_tables(engine.table(spark, str(tmp_path), "pages"), "page_id", "html", key="url")
    assert "Join" not in recs._jdf.queryExecution().optimizedPlan().toString() and {r.key for r in recs.collect()} == {p[1] for p in pages}


@pytest.mark.parametrize("name", ["orders", "conversations"])
def test_extents_are_written_without_sorting(spark, tmp_path, sf_dir, monkeypatch, name):
    """A field of an order is a part of a union: its rows go to files as they come, and the lines of orders are summed up once."""
    plans = []

    def keep(df, tag, **o):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, tag, **o)

    monkeypatch.setattr(engine, "written", keep)
    monkeypatch.setattr(engine, "_MADE", {})
    c = getattr(engine, name)(spark, sf_dir)
    own = [p for tag, p in plans if tag == "extents"]
    assert len(own) == 1 and "rangepartitioning" not in own[0]
    if name == "orders":
        assert not re.search(r"\b(Sort|Exchange|HashAggregate)\b", own[0])
        files = c.extents.select("field", F.input_file_name().alias("file")).distinct().groupBy("file").count()
        assert files.where("count > 1").count() == 0 and c.extents.select("field").distinct().count() == 8


def test_texts_are_gone_through_once_for_their_hits(spark):
    """Words as written, among letters of several bytes: no hit looks for its place from the text's beginning."""
    text = "Äö The thE the-x The. 'The The,9 \U0001f600The _The The " * 3
    df = spark.createDataFrame([(1, text), (2, "the"), (3, "The"), (4, None)], "i long, t string")
    c = collection.Collection.of(collection.records(df, "i", "t"))
    at = [m.start() for m in re.finditer("The(?![a-z0-9])", text) if not re.match("[a-z0-9]", text[m.start() - 1 : m.start()].lower())]
    for find, word in ((terms.case_term, "The"), (terms.case_prefix, "Th")):
        found = find(c, word)
        assert "substring" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        assert {r.rec_id: ([h.start for h in r.hits], r.hit_count) for r in found.collect()} == {1: (at, len(at)), 3: ([0], 1)}
    alone = [m.start() for m in re.finditer(r"(?<![\w.,'-])the(?![\w-]|[.,']\w)", text.lower(), re.ASCII)]
    assert {r.rec_id: [h.start for h in r.hits] for r in terms.exact_term(c, "the").collect()} == {1: alone, 2: [0], 3: [0]}
