"""Formats: records, fields and places."""

import json

import pytest

from hitweave.collection import Collection
from hitweave.plans import Engine
from hitweave.sources import FORMATS, read, register, tables
from hitweave.sources.formats import detect, filtered, unregister
from hitweave.sources.markup import elements, parse

SAMPLES = {
    "CSV": ("id,name,price\n1,\"a, b\",2.5\n2,\"two\nlines\",3,extra\n", 2, {"name": "a, b", "price": "2.5"}, "1"),
    "TSV": ("id\tname\n7\tseven\n", 1, {"name": "seven"}, "7"),
    "JSON": ('{"id": "x", "a": {"b": [1, "two", {"c": true}]}} // note\n{"id": "y", "n": null, "s": ""}', 2, {"a|b|0": "1", "a|b|1": "two", "a|b|2|c": "true"}, "x"),
    "EJSON": ('{"_id": {"$oid": "5f"}, "at": {"$date": "2020-01-02"}}', 1, {"at": "2020-01-02"}, "5f"),
    "JSON-LD": ('{"@context": {"x": "y"}, "@graph": [{"@id": "n1", "name": "One"}, {"@id": "n2", "name": "Two"}]}', 2, {"name": "One"}, "n1"),
    "ESBULK": ('{"index": {"_id": "1"}}\n{"t": "one"}\n{"delete": {"_id": "2"}}\n{"update": {"_id": 3}}\n{"doc": {"t": "three"}}\n', 3, {"t": "one"}, "1"),
    "CIRRUS": ('{"index": {"_id": "1"}}\n{"t": ["one", "two"]}\n', 1, {"t": "one"}, "1"),
    "XML": ('<?xml version="1.0"?><r><id>k1</id><a x="1 &amp; 2"><b>Hello</b> <![CDATA[<raw>]]></a><e/></r>', 1, {"r/a/b": "Hello", "r/a@x": "1 & 2"}, "k1"),
    "RSS": ("<rss><channel><item><title>One</title><guid>g1</guid></item><item><title>Two</title></item></channel></rss>", 2, {"item/title": "One"}, "g1"),
    "ATOM": ("<feed><entry><title>One</title><id>e1</id></entry></feed>", 1, {"entry/title": "One"}, "e1"),
    "HTML": ("<!DOCTYPE html><html><head><title>T &eacute;</title><script>x</script></head><body><p>One<p>Two <b>bold</b><ul><li>a<li>b</ul><img src=i.png></body></html>", 1, {"html/head/title": "T é", "html/body/p": "One", "html/body/p/b": "bold"}, None),
    "HTMLMETA": ('<html><head><title>T</title><meta name="Author" content="A. B."></head><body>no</body></html>', 1, {"author": "A. B.", "head/title": "T"}, None),
    "PLAINTEXT": ("First line.\nStill the first paragraph. Yes!\n\nSecond one.\fPage two", 1, {"firstline": "First line.", "paragraph": "First line.\nStill the first paragraph. Yes!", "page": "First line.\nStill the first paragraph. Yes!\n\nSecond one."}, None),
    "PARA": ("one\nstill one\n\n\ntwo", 2, {"paragraph": "one\nstill one"}, None),
    "ONELINE": ("one\n\n two \nthree", 3, {"line": "one"}, None),
    "FIRSTLINE": ("\nHead\nbody", 1, {"headline": "Head"}, None),
    "COLONDOC": ("Key: k7\nTitle: A title\n  that goes on\nDate: 2020-05-06\n", 1, {"Title": "A title\n  that goes on", "Date": "2020-05-06"}, "k7"),
    "COLONGRP": ("Id: 1\nName: one\n\nId: 2\nName: two\n", 2, {"Name": "one"}, "1"),
    "BIBTEX": ('@article{knuth84, author = {D. {E.} Knuth}, title = "Literate, Programming", year = 1984 }\n@comment{no}\n@book{b2, title={B}}', 2, {"author": "D. {E.} Knuth", "title": "Literate, Programming", "year": "1984", "type": "article"}, "knuth84"),
    "RIS": ("TY  - JOUR\nTI  - A title\nAU  - One, A.\nAU  - Two, B.\nID  - r1\nER  - \nTY  - BOOK\nTI  - Other\nER  - \n", 2, {"title": "A title", "author": "One, A."}, "r1"),
    "MEDLINE": ("PMID- 11\nTI  - A title\n      goes on\nAU  - X\n\nPMID- 12\nTI  - Next\n", 2, {"title": "A title\n      goes on"}, "11"),
    "REFERBIB": ("%T One\n%A First\n%D 1999\n\n%T Two\n%A Second\n", 2, {"title": "One", "author": "First"}, None),
    "SOIF": ("@FILE { http://x/y\nTitle{6}:\tHéllo\nType{4}:\tText\n}\n", 1, {"title": "Héllo", "type": "Text"}, "http://x/y"),
    "MAILFOLDER": ("From a@b Mon Mar  2 10:00:00 2020\nFrom: A <a@b>\nSubject: One\n two\nMessage-ID: <1@x>\nDate: Mon, 02 Mar 2020 10:00:00 +0000\n\nBody here.\n\nFrom c@d Tue Mar  3 10:00:00 2020\nSubject: Two\n\nMore.\n", 2, {"subject": "One\n two", "body": "Body here."}, "<1@x>"),
    "MAILDIGEST": ("A digest\n\n------------------------------\n\nFrom: x\nSubject: One\n\nText one.\n\n------------------------------\n\nFrom: y\nSubject: Two\n\nText two.\n", 2, {"subject": "One", "body": "Text one."}, None),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_formats(name):
    source, count, fields, key = SAMPLES[name]
    docs = list(FORMATS[name](source))
    assert len(docs) == count and docs[0].key == key
    first = {}
    for f in docs[0].fields:
        first.setdefault(f.path, f.txt if f.start is None or f.txt is not None else docs[0].text[f.start : f.end + 1])
        if f.start is not None:
            assert 0 <= f.start <= f.end < len(docs[0].text)
    for path, value in fields.items():
        assert first[path] == value, path


@pytest.mark.parametrize("name", sorted(set(FORMATS)))
def test_formats_stand_anything(name):
    for source in ("", " ", "\n\n", "<", "{", "@", "a: b", "%T", "From x 1\n", "\0", "é" * 50, "<a" * 200, "[[[{}", '"' * 99, "@x{y" * 20):
        make = FORMATS[name]
        for doc in make(source.encode() if make.binary else source):
            for f in doc.fields:
                assert f.start is None or 0 <= f.start <= f.end < len(doc.text)


def test_detection():
    same = {"TSV": "CSV", "CIRRUS": "ESBULK", "HTMLMETA": "HTML", "PARA": "PLAINTEXT", "FIRSTLINE": "PLAINTEXT", "ONELINE": "PLAINTEXT"}
    for name, (source, *_) in SAMPLES.items():
        assert detect(source.encode()) == same.get(name, name), name
    assert detect(b"\x89PNG\r\n\x1a\n....") == "IMAGE" and detect(b"%PDF-1.4") == "BINARY" and detect(b"") == "PLAINTEXT"


def test_binary_formats():
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert {f.path: f.txt for f in next(iter(FORMATS["PNG"](png))).fields} == {"kind": "png", "width": "640", "height": "480", "bytes": "24"}
    assert next(iter(FORMATS["BINARY"](b"\0\1hello\0\2wo\0world!"))).text == "hello\nworld!"
    data = b"k42 \x1e" + b"10\x1faTitle\x1fbSub\x1e"
    directory = b"001" + b"0005" + b"00000" + b"245" + b"%04d" % (len(data) - 5) + b"00005" + b"\x1e"
    base = 24 + len(directory)
    leader = b"%05dnam  22%05d   4500" % (base + len(data) + 1, base)
    doc = next(iter(FORMATS["MARC"](leader + directory + data + b"\x1d")))
    assert doc.key == "k42" and {f.path: doc.text[f.start : f.end + 1] for f in doc.fields}["245$a"] == "Title"


def test_markup_places_and_nesting():
    text, fields = parse("<div><h1> A  b </h1><p>One<br>two</p><p>x</div>")
    got = {(p, text[s : e + 1]) for p, s, e, _, _ in fields if s is not None and e >= s}
    assert ("div/h1", "A b") in got and ("div/p", "One\ntwo") in got and ("div/p", "x") in got
    assert list(elements("<a><i>1<i>2</i></i><i/></a>", "i")) == [(3, 19), (19, 23)]
    assert parse("<p>a<p>b<div>c</div></section>x")[0].split() == ["a", "b", "c", "x"]


def test_reading_files(spark, tmp_path):
    for name, (source, *_) in SAMPLES.items():
        (tmp_path / f"{name.lower()}.dat").write_text(source, encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.xml").write_text("<r><t>deep words</t></r>")
    recs, exts = read(spark, str(tmp_path))
    assert {r.doctype for r in recs.collect()} >= {"CSV", "JSON", "XML", "HTML", "BIBTEX", "RIS", "MAILFOLDER", "ESBULK", "SOIF"}
    c = Collection.of(recs, exts)
    assert [r.rec_id for r in Engine(c).compile("t/deep").collect()] and Engine(c).compile("title/programming").count() == 1
    assert Engine(c, types={"price": "number"}).compile("price>=2.5").count() == 2
    deleted = recs.where("deleted").collect()
    assert [r.key for r in deleted] == ["2"]
    few, _ = read(spark, str(tmp_path), "XML", glob="*.xml", row_tag="t")
    assert [r.text for r in few.collect()] == ["deep words"]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name;day\n1;"x; y";2020-01-02\n2;z;1999\n')
    recs, exts = tables.csv(spark, str(tmp_path / "a.csv"), key="id")
    rows = {r.key: r for r in recs.collect()}
    assert set(rows) == {"1", "2"} and rows["1"].text == "1\nx; y\n2020-01-02"
    e = exts.collect()
    for x in e:
        text = next(r.text for r in rows.values() if r.rec_id == x.rec_id)
        assert text[x.f_start : x.f_end + 1] == x.txt
    assert {(x.field, str(x.ts_lo)) for x in e if x.ts_lo} >= {("day", "2020-01-02 00:00:00"), ("day", "1999-01-01 00:00:00")}
    (tmp_path / "a.ndjson").write_text("\n".join(json.dumps(x) for x in ({"k": "a", "v": {"n": 1}}, {"k": "b", "v": [1, 2]})) + "\n")
    recs, exts = tables.ndjson(spark, str(tmp_path / "a.ndjson"), key="k")
    assert {r.key for r in recs.collect()} == {"a", "b"} and {(x.path, x.num) for x in exts.collect() if x.num} == {("v/n", 1.0), ("v/0", 1.0), ("v/1", 2.0)}
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": 2}]}'), (2, None), (3, "not json"), (4, "[]")], "i long, j string")
    assert {(x.rec_id, x.path) for x in tables.json_extents(rows, "i", "j", arrays=False).collect()} == {(1, "a"), (1, "a/b")}


def test_own_formats(spark, tmp_path):
    (tmp_path / "x.up").write_text("words in here")
    register("UPPER")(filtered(["tr", "a-z", "A-Z"], "ONELINE"))
    FORMATS["UPPER"].binary = True
    try:
        recs, _ = read(spark, str(tmp_path), "UPPER")
        assert [r.text for r in recs.collect()] == ["WORDS IN HERE"]
    finally:
        unregister("UPPER")
    assert "UPPER" not in FORMATS


MANY = {
    "RIS": ("TY  - JOUR\nTI  - Nr {n} é\nID  - {n}\nER  - \n", {}),
    "MEDLINE": ("PMID- {n}\nTI  - Nr {n}\n      goes on\n\n", {}),
    "DIALOG-B": ("AN- {n}\nTI- Nr {n}\n", {}),
    "REFERBIB": ("%T Nr {n}\n%M {n}\n\n\n", {}),
    "MAILFOLDER": ("From a@b Mon Mar  2 10:00:00 2020\nSubject: Nr {n}\nMessage-ID: <{n}@x>\n\nFrom here on.\n>From {n}\n\n\n\n", {}),
    "ONELINE": ("Nr {n}\n\n", {}),
    "NDJSON": ('{{"id": {n}, "a": ["Nr", {n}]}}\n', {}),
    "RSS": ("<item><guid>{n}</guid><title>Nr {n}</title></item>\n", {}),
    "ATOM": ("<entry><id>{n}</id><title>Nr {n}</title></entry>", {}),
    "XML": ('<r a="{n}"><id>{n}</id></r>', {"row_tag": "r"}),
}


@pytest.mark.parametrize("name", MANY)
def test_split_files(spark, tmp_path, name):
    """Files cut anywhere give the records that they give as a whole."""
    from pyspark.sql import functions as F

    source, options = MANY[name]
    for file, count in (("a", 150), ("b", 1), ("c", 0), ("d", 40)):
        (tmp_path / file).write_text("".join(source.format(n=n) for n in range(count)), encoding="utf-8")

    def got(**how):
        recs, exts = read(spark, str(tmp_path), name, **options, **how)
        whole = exts.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("path", "txt", "f_start", "f_end"))).alias("f"))
        rows = recs.join(whole, "rec_id", "left").select("rec_id", "file_name", "text", F.to_json("f").alias("f")).collect()
        assert len({r.rec_id for r in rows}) == len(rows)
        return sorted((r.file_name, r.text.strip(), r.f) for r in rows)

    want = got()
    assert len(want) >= 191
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
        assert got(split=True) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_split_needs_marks(spark, tmp_path):
    for name in ("BIBTEX", "PARA", "XML"):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path), name, split=True)
