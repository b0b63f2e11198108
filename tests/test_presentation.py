"""Headlines, contexts, highlights and tables of hits."""

import json

import pytest
from pyspark.sql import functions as F

from hitweave import presentation as P
from hitweave.collection import Collection, extents, records
from hitweave.plans import Engine


@pytest.fixture(scope="module")
def c(spark):
    df = spark.createDataFrame([(1, "First line <b>\nsecond alpha beta alpha end"), (2, "alpha"), (3, "nothing")], "i long, t string")
    exts = extents(df, "title", rec_id="i", f_start=F.lit(0), f_end=F.lit(4), txt=F.substring("t", 1, 5))
    return Collection.of(records(df, "i", "t", key=F.concat(F.lit("k"), F.col("i").cast("string"))), exts)


def by(df, column):
    return {r.rec_id: r[column] for r in df.collect()}


def test_pieces(c):
    found = Engine(c).compile("alpha")
    assert by(P.headline(found, c), "headline") == {1: "First line <b>", 2: "alpha"} and by(P.headline(found, c, field="title"), "headline") == {1: "First", 2: "alpha"}
    assert by(P.summary(found, c, 12), "summary") == {1: "First line", 2: "alpha"}
    assert by(P.context(found, c, 3), "context") == {1: "nd alpha be", 2: "alpha"} and by(P.nth_context(found, c, 1, 1), "context") == {1: " alpha ", 2: None}


def test_highlight(c):
    assert by(P.highlighted(Engine(c).compile("alpha"), c, "[", "]"), "text") == {1: "First line <b>\nsecond [alpha] beta [alpha] end", 2: "[alpha]"}
    assert by(P.highlighted(Engine(c).compile("alpha alp* OR"), c, "[", "]"), "text")[2] == "[alpha]"


def test_tables_of_hits(c):
    found = Engine(c).compile("alpha")
    assert json.loads(by(P.hits_json(found), "hits")[1]) == [{"start": 22, "end": 26}, {"start": 33, "end": 37}]
    assert by(P.hits_xml(found), "hits")[2] == '<HITS COUNT="1"><HIT START="0" END="4"/></HITS>'


def test_element_sets(c):
    found = Engine(c).compile("alpha")
    assert by(P.present(found, c, "B", "html"), "content")[1] == "First line &lt;b&gt;" and by(P.present(found, c, "F"), "content")[2] == "alpha"
    assert json.loads(by(P.present(found, c, "M"), "content")[1])["key"] == "k1" and by(P.present(found, c, "title"), "content")[1] == "First"
    assert json.loads(by(P.present(found, c, "H", "json"), "content")[2]) == {"rec_id": 2, "content": "<b>alpha</b>"} and by(P.present(found, c, "S"), "content")[2] == "alpha"


def test_reports(c):
    found = Engine(c).compile("alpha")
    assert by(P.report(found, c, "terse"), "line") == {1: "k1", 2: "k2"} and by(P.report(found, c, "tab"), "line")[2].split("\t")[1:] == ["k2", "", "1", "alpha"]
    assert json.loads(by(P.report(found, c, "json"), "line")[2])["key"] == "k2" and "<key>k2</key>" in by(P.report(found, c, "xml"), "line")[2]
    with pytest.raises(ValueError):
        P.report(found, c, "unknown")


def test_centroid(c):
    got = {(r.kind, r.name): r.freq for r in P.centroid(c).collect()}
    assert got["word", "alpha"] == 3 and got["field", "title"] == 3
