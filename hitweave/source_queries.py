"""Registered queries of the sources and the store: tables are written as files of each format, read back and compared with the tables.

A row becomes a record by a template; a file holds the records of ``PER`` keys in a
row.  The queries give the records' keys, their fields, what these cover of the
record's text, and whether that is the field's own value but for white space.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection import records
from .plans import search
from .queries import query, table
from .sources import read, tables
from .storage import folder
from .streaming.ingest import files as ingest_files
from .streaming.ingest import ingest
from .streaming.store import Store

#: Keys in one file.
PER = 1_000


def _row(template: str) -> Column:
    """``{column}`` gives way to the column's value, ``{#column}`` to its length in bytes."""
    parts = [p for p in re.split(r"(\{#?[pn]_\w+\})", template) if p]
    own = [F.octet_length(p[2:-1]) if p.startswith("{#") else F.col(p[1:-1]) if re.fullmatch(r"\{[pn]_\w+\}", p) else F.lit(p) for p in parts]
    return F.concat(*[c.cast("string") for c in own])


def files(df: DataFrame, key: str, row: Column, head: str = "", between: str = "\n", tail: str = "\n", per: int = PER) -> str:
    """The folder of the files that hold ``row`` of all rows of ``df`` in the order of ``key``, of ``per`` keys each."""
    one = df.select(F.floor(F.col(key) / per).alias("part"), F.col(key).alias("key"), row.alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "row"))), lambda x: x["row"]), between)
    path = folder(df.sparkSession, "files")
    one.groupBy("part").agg(F.concat(F.lit(head), text, F.lit(tail)).alias("value")).write.partitionBy("part").option("lineSep", "\n").text(path)
    return path


def _fields(recs: DataFrame, exts: DataFrame, paths: list[str], keyed: bool) -> DataFrame:
    value = F.expr("coalesce(substring(text, cast(f_start + 1 as int), cast(f_end - f_start + 1 as int)), txt)").alias("value")
    both = exts.where(F.col("path").isin(paths)).join(recs.select("rec_id", "key", "text"), "rec_id").select("key", "path", value, "txt")
    return both.select(*(["key"] if keyed else []), "path", "value", (F.regexp_replace("value", r"\s+", " ") == F.col("txt")).alias("placed"))


def _registered(name: str, format: str, template: str, want: dict[str, str], key: str | None = "p_partkey", source: str = "part", options: dict | None = None, **shape) -> None:
    """``want``: SQL of each path's value; several, parted by ``;``, where the field repeats.  ``key``: SQL of the record's key."""
    own = f"CAST({key} AS VARCHAR) AS key, " if key else ""
    sql = " UNION ALL ".join(
        f"SELECT {own}'{path}' AS path, CAST({value} AS VARCHAR) AS value, TRUE AS placed FROM {source}" for path, values in want.items() for value in values.split("; ")
    )

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        by = "p_partkey" if source == "part" else "n_nationkey"
        path = files(table(spark, sf_dir, source), by, _row(template), **shape)
        return _fields(*read(spark, path, format, **(options or {})), list(want), key is not None)

    run.__name__ = name
    run.__doc__ = f"{format}: the fields of a table's rows, written as files of this format."
    query(name, sql)(run)


_registered(
    "source_csv", "CSV", '{p_partkey},"{p_name}",{p_brand},"{p_type}, ""of""\n{p_size}"',
    {"id": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type || ', \"of\"' || chr(10) || p_size"}, head="id,name,brand,type\n",
)
_registered("source_tsv", "TSV", "{p_partkey}\t{p_name}\t{p_brand}", {"name": "p_name", "field03": "p_brand"}, head="id\tname\n")
_registered(
    "source_json", "JSON", '{"id": {p_partkey}, "name": {"full": "{p_name}", "more": ["{p_brand}", {"type": "{p_type}"}]}} // {p_size}',
    {"id": "p_partkey", "name/full": "p_name", "name/more/0": "p_brand", "name/more/1/type": "p_type"},
)
_registered("source_ejson", "EJSON", '{"_id": {"$oid": "{p_partkey}"}, "size": {"$numberLong": "{p_size}"}, "name": "{p_name}"}', {"size": "p_size", "name": "p_name"}, head="[", between=",\n", tail="]\n")
_registered(
    "source_jsonld", "JSON-LD", '{"@id": "part:{p_partkey}", "name": "{p_name}"}', {"name": "p_name"}, key="'part:' || p_partkey",
    head='{"@context": {"name": "urn:name"}, "@graph": [', between=",\n", tail="]}\n",
)
_registered("source_es_bulk", "ESBULK", '{"index": {"_id": "{p_partkey}"}}\n{"name": "{p_name}", "brand": "{p_brand}"}', {"name": "p_name", "brand": "p_brand"})
_registered("source_cirrus", "CIRRUS", '{"index": {"_id": {p_partkey}}}\n{"title": "{p_name}", "category": ["{p_brand}", "{p_type}"]}', {"title": "p_name", "category": "p_brand; p_type"})
_registered(
    "source_xml", "XML", '<part size="{p_size}"><id>{p_partkey}</id><name>{p_name} &amp; &#x3c;{p_brand}&gt;</name><type><![CDATA[<{p_type}>]]></type></part>',
    {"part@size": "p_size", "part/name": "p_name || ' & <' || p_brand || '>'", "part/type": "'<' || p_type || '>'"},
    head='<?xml version="1.0"?>\n<parts>', tail="</parts>\n", options={"row_tag": "part"},
)
_registered(
    "source_rss", "RSS", "<item><title>{p_name}</title><guid>part-{p_partkey}</guid><category>{p_brand}</category></item>", {"item/title": "p_name", "item/category": "p_brand"},
    key="'part-' || p_partkey", head='<rss version="2.0"><channel><title>Parts</title>', tail="</channel></rss>\n",
)
_registered("source_atom", "ATOM", "<entry><id>{p_partkey}</id><title>{p_name}</title></entry>", {"entry/title": "p_name"}, head="<feed><title>Parts</title>", tail="</feed>\n")
_registered(
    "source_html", "HTML", "<!DOCTYPE html><html><head><title>{n_name}</title></head><body><p>On {n_name}<p>number <b>{n_nationkey}</b></body></html>",
    {"html/head/title": "n_name", "html/body/p": "'On ' || n_name; 'number ' || n_nationkey", "html/body/p/b": "n_nationkey"}, key=None, source="nation", per=1,
)
_registered(
    "source_html_meta", "HTMLMETA", '<html><head><title>{n_name}</title><meta name="Author" content="{n_nationkey}"></head><body>{n_name}</body></html>',
    {"head/title": "n_name", "author": "n_nationkey"}, key=None, source="nation", per=1,
)
_registered("source_plaintext", "PLAINTEXT", "On {n_name}.\nIts number\n\nis {n_nationkey}.", {"firstline": "'On ' || n_name || '.'", "paragraph": "'On ' || n_name || '.' || chr(10) || 'Its number'; 'is ' || n_nationkey || '.'"}, key=None, source="nation", per=1)
_registered("source_firstline", "FIRSTLINE", "\n{n_name}\n{n_nationkey}", {"headline": "n_name"}, key=None, source="nation", per=1)
_registered("source_para", "PARA", "{p_name}\n{p_brand}", {"paragraph": "p_name || chr(10) || p_brand"}, key=None, between="\n \n")
_registered("source_oneline", "ONELINE", "{p_partkey}: {p_name}", {"line": "p_partkey || ': ' || p_name"}, key=None)
_registered("source_colondoc", "COLONDOC", "Key: {n_nationkey}\nTitle: {n_name}\n  that goes on\n", {"title": "n_name || chr(10) || '  that goes on'"}, key="n_nationkey", source="nation", per=1)
_registered("source_colongrp", "COLONGRP", "Id: {p_partkey}\nName: {p_name}\nBrand: {p_brand}", {"name": "p_name", "brand": "p_brand"}, between="\n\n")
_registered(
    "source_bibtex", "BIBTEX", '@misc{part{p_partkey}, title = {{p_name} {of} {p_brand}}, note = "{p_type}, {p_brand}", year = {p_size} }',
    {"type": "'misc'", "title": "p_name || ' {of} ' || p_brand", "note": "p_type || ', ' || p_brand", "year": "p_size"}, key="'part' || p_partkey", head="@comment{parts}\n",
)
_registered("source_ris", "RIS", "TY  - JOUR\nTI  - {p_name}\nAU  - {p_brand}\nAU  - {p_type}\nID  - {p_partkey}\nER  - ", {"title": "p_name", "author": "p_brand; p_type"})
_registered("source_medline", "MEDLINE", "PMID- {p_partkey}\nTI  - {p_name}\n      goes on\nAU  - {p_brand}\n", {"title": "p_name || chr(10) || '      goes on'", "author": "p_brand"})
_registered("source_refer", "REFERBIB", "%T {p_name}\n%A {p_brand}\n%M {p_partkey}", {"title": "p_name", "author": "p_brand"}, between="\n\n")
_registered("source_dialog_b", "DIALOG-B", "AN- {p_partkey}\nTI- {p_name}\nAU- {p_brand}\n", {"title": "p_name", "author": "p_brand"})
_registered("source_soif", "SOIF", "@FILE { http://parts/{p_partkey}\ntitle{{#p_name}}:\t{p_name}\nbrand{{#p_brand}}:\t{p_brand}\n}", {"title": "p_name", "brand": "p_brand"}, key="'http://parts/' || p_partkey")
_registered(
    "source_mailfolder", "MAILFOLDER", "From a@b Mon Mar  2 10:00:00 2020\nSubject: {p_name}\n of {p_brand}\nMessage-ID: <{p_partkey}@parts>\n\n>From {p_type} on.\n",
    {"subject": "p_name || chr(10) || ' of ' || p_brand", "body": "'>From ' || p_type || ' on.'"}, key="'<' || p_partkey || '@parts>'",
)
_registered(
    "source_maildigest", "MAILDIGEST", "From: a@b\nSubject: {p_name}\nMessage-ID: <{p_partkey}@parts>\n\n{p_brand} is here.", {"subject": "p_name", "body": "p_brand || ' is here.'"},
    key="'<' || p_partkey || '@parts>'", head=f"Of parts\n\n{'-' * 30}\n\n", between=f"\n\n{'-' * 30}\n\n",
)
_registered("source_ris_split", "RIS", "TY  - JOUR\nTI  - {p_name}\nAU  - {p_brand}\nAU  - {p_type}\nID  - {p_partkey}\nER  - ", {"title": "p_name", "author": "p_brand; p_type"}, options={"split": True})
_registered(
    "source_xml_split", "XML", '<part size="{p_size}"><id>{p_partkey}</id><name>{p_name}</name></part>', {"part@size": "p_size", "part/name": "p_name"},
    head="<parts>", tail="</parts>\n", options={"row_tag": "part", "split": True},
)
_registered("source_autodetect", "AUTODETECT", "TY  - JOUR\nTI  - {p_name}\nID  - {p_partkey}\nER  - ", {"title": "p_name"})


@query("source_marc", "SELECT CAST(p_partkey AS VARCHAR) AS key, u.path, u.value, TRUE AS placed FROM part, LATERAL (VALUES ('245$a', p_name), ('245$b', p_brand)) u(path, value)")
def source_marc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO 2709: the fields of a table's rows, written as records of a leader, a directory and two fields."""
    end, sub = F.lit("\x1e"), F.lit("\x1f")
    number, title = F.concat(F.col("p_partkey").cast("string"), end), F.concat(F.lit("10"), sub, F.lit("a"), "p_name", sub, F.lit("b"), "p_brand", end)
    a, b = F.octet_length(number), F.octet_length(title)
    base = 24 + 2 * 12 + 1

    def digits(n: Column, width: int) -> Column:
        return F.lpad(n.cast("string"), width, "0")

    directory = F.concat(F.lit("001"), digits(a, 4), F.lit("00000245"), digits(b, 4), digits(a, 5), end)
    leader = F.concat(digits(base + a + b + 1, 5), F.lit(f"nam  22{base:05d}   4500"))
    path = files(table(spark, sf_dir, "part"), "p_partkey", F.concat(leader, directory, number, title, F.lit("\x1d")), between="")
    return _fields(*read(spark, path, "MARC"), ["245$a", "245$b"], True)


@query("source_ndjson_lines", "SELECT CAST(p_partkey AS VARCHAR) AS key, u.path, u.value, TRUE AS placed FROM part, LATERAL (VALUES ('name/full', p_name), ('size', CAST(p_size AS VARCHAR))) u(path, value)")
def source_ndjson_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON by Spark's own reader, which splits large files."""
    path = files(table(spark, sf_dir, "part"), "p_partkey", _row('{"id": "{p_partkey}", "name": {"full": "{p_name}"}, "size": {p_size}}'))
    return _fields(*tables.ndjson(spark, path, key="id"), ["name/full", "size"], True)


@query("source_csv_table", "SELECT CAST(p_partkey AS VARCHAR) AS key, u.path, u.value, TRUE AS placed FROM part, LATERAL (VALUES ('name', p_name || chr(10) || 'of'), ('brand', p_brand)) u(path, value)")
def source_csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of CSV by Spark's own reader; the text is what ``of_columns`` makes of them."""
    path = files(table(spark, sf_dir, "part"), "p_partkey", _row('{p_partkey};"{p_name}\nof";{p_brand}'), head="id;name;brand\n")
    return _fields(*tables.csv(spark, path, key="id"), ["name", "brand"], True)


# --- the store ---------------------------------------------------------------------------------------------------------------------------------------

#: Of each user the newest event by (number modulo 3, number); users of a multiple of four are deleted, those of eight come back.
_LIVE = (
    "SELECT event_id, user_id, event_type, ts FROM events WHERE user_id % 4 <> 0 OR user_id % 8 = 0 "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1"
)


def _store(spark: SparkSession, sf_dir: str) -> Store:
    """Three batches of events, a batch that deletes, one that restores; the second batch is written twice."""
    events = table(spark, sf_dir, "events")
    key = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    store = Store(spark, folder(spark, "store"))
    for batch in (0, 1, 1, 2):
        own = events.where(F.col("event_id") % 3 == batch)
        store.append(batch, records(own, "event_id", "event_type", key=key, date=F.col("ts").cast("timestamp"), date_expires=F.col("ts").cast("timestamp") + F.expr("INTERVAL 10 DAYS")))
    users = events.select("user_id", key.alias("key"))
    store.delete(3, users.where("user_id % 4 = 0"))
    store.delete(4, users.where("user_id % 8 = 0"), restore=True)
    return store


@query("store_live", f"SELECT event_id AS rec_id, 'user-' || user_id AS key FROM ({_LIVE})")
def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts of a store after batches, deletions and restorations."""
    return _store(spark, sf_dir).live().select("rec_id", "key")


@query("store_expired", f"SELECT event_id AS rec_id, 'user-' || user_id AS key FROM ({_LIVE}) WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20 00:00:00'")
def store_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts of a store at a time: records that have expired by then don't."""
    return _store(spark, sf_dir).live(F.lit("2024-01-20").cast("timestamp")).select("rec_id", "key")


@query("store_search", f"SELECT event_id AS rec_id, 1 AS hit_count FROM ({_LIVE}) WHERE event_type = 'click'")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word among what counts of a store."""
    return search(_store(spark, sf_dir).collection(), "click").select("rec_id", "hit_count")


@query("store_compact", f"SELECT event_id AS rec_id, 'user-' || user_id AS key, event_type AS text, CAST(0 AS BIGINT) AS batch FROM ({_LIVE})")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one batch that holds what counts of another."""
    return _store(spark, sf_dir).compact(folder(spark, "store")).live().select("rec_id", "key", "text", "batch")


@query("store_stream", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey || chr(10) || p_name || chr(10) || p_brand AS text FROM part")
def store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a stream appends to a store, each micro-batch as one of its own."""
    path = files(table(spark, sf_dir, "part"), "p_partkey", _row("{p_partkey},{p_name},{p_brand}"), head="id,name,brand\n")
    store = Store(spark, folder(spark, "store"))
    ingest(ingest_files(spark, path, "CSV"), store, folder(spark, "stream")).awaitTermination()
    return store.live().select("key", "text")
