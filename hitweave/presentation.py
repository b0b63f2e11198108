"""Presenting results: headlines, contexts, highlighted texts, tables of hits, and records in formats of exchange."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .collection import Collection
from .operators.structural import of_field


def _piece(text: str, start: Column, length: Column) -> Column:
    """``length`` characters of the text from ``start`` (from 0)."""
    return F.substr(F.col(text), (start + 1).cast("int"), length.cast("int"))


def _with_text(found: DataFrame, c: Collection) -> DataFrame:
    return found.join(c.records.select("rec_id", "text"), "rec_id")


def headline(found: DataFrame, c: Collection, size: int = 80, field: str | None = None) -> DataFrame:
    """Adds ``headline``: the first instance of a field where given and there, else the beginning of the first line."""
    first = F.regexp_extract("text", r"^\s*([^\n]{0,%d})" % size, 1)
    rows = _with_text(found, c)
    if field is None:
        return rows.withColumn("headline", first).drop("text")
    own = of_field(c.extents, field).groupBy("rec_id").agg(F.min_by("txt", F.coalesce("f_start", F.lit(0))).alias("_head"))
    return rows.join(own, "rec_id", "left").withColumn("headline", F.coalesce("_head", first)).drop("text", "_head")


def summary(found: DataFrame, c: Collection, size: int = 400) -> DataFrame:
    """Adds ``summary``: the beginning of the text on one line, cut at a word."""
    line = F.trim(F.regexp_replace("text", r"\s+", " "))
    cut = F.regexp_extract(line, r"^(.{0,%d})(?:\s|$)" % size, 1)
    return _with_text(found, c).withColumn("summary", cut).drop("text")


def nth_context(found: DataFrame, c: Collection, n: int = 0, around: int = 60) -> DataFrame:
    """Adds ``context``: the ``n``-th hit (from 0, by place) with the characters around it; null with fewer hits."""
    rows = _with_text(found, c).withColumn("_h", F.get(F.array_sort("hits"), n))
    start = F.greatest(F.col("_h.start") - around, F.lit(0))
    return rows.withColumn("context", _piece("text", start, F.col("_h.end") - start + around + 1)).drop("text", "_h")


def context(found: DataFrame, c: Collection, around: int = 60) -> DataFrame:
    """Adds ``context``: the first hit with the characters around it."""
    return nth_context(found, c, 0, around)


def highlighted(found: DataFrame, c: Collection, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """Adds ``text`` with marks around every hit; hits that overlap share theirs."""
    spans = F.aggregate(
        F.array_sort("hits"),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda a, h: F.when(
            (F.size(a) > 0) & (h["start"] <= F.element_at(a, -1)["end"]),
            F.concat(
                F.slice(a, F.lit(1), F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], h["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(h["start"].alias("start"), h["end"].alias("end"))))),
    )
    rows = _with_text(found, c).withColumn("_spans", spans)
    marked = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], _piece("text", a["at"], s["start"] - a["at"]), F.lit(before), _piece("text", s["start"], s["end"] - s["start"] + 1), F.lit(after)).alias("out"),
            (s["end"] + 1).alias("at"),
        ),
        lambda a: F.concat(a["out"], _piece("text", a["at"], F.char_length("text") - a["at"])),
    )
    return rows.withColumn("text", marked).drop("_spans")


def _places() -> Column:
    return F.transform(F.array_sort("hits"), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))


def hits_json(found: DataFrame) -> DataFrame:
    """``hits`` as a JSON array of places, in order."""
    return found.withColumn("hits", F.to_json(_places()))


def hits_xml(found: DataFrame) -> DataFrame:
    """``hits`` as XML, in order."""
    one = F.transform(_places(), lambda h: F.format_string('<HIT START="%d" END="%d"/>', h["start"], h["end"]))
    return found.withColumn("hits", F.concat(F.format_string('<HITS COUNT="%d">', F.size("hits")), F.array_join(one, ""), F.lit("</HITS>")))


def present(found: DataFrame, c: Collection, element_set: str = "B", syntax: str = "text", start: str = "<b>", end: str = "</b>") -> DataFrame:
    """``(rec_id, content)`` by an element set: B (headline), S (summary), F (full text), H (full, highlighted), M (metadata as JSON) or a field.

    ``syntax``: text, html (escaped) or json.
    """
    kinds = {"B": lambda: (headline(found, c), "headline"), "S": lambda: (summary(found, c), "summary"), "F": lambda: (_with_text(found, c), "text"), "H": lambda: (highlighted(found, c, start, end), "text")}
    if element_set in kinds:
        rows, name = kinds[element_set]()
        content = F.col(name)
    elif element_set == "M":
        meta = [x for x in c.records.columns if x not in ("rec_id", "text")]
        rows = found.select("rec_id").join(c.records, "rec_id")
        content = F.to_json(F.struct(*meta))
    else:
        own = of_field(c.extents, element_set).groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f_start", "txt"))), lambda x: x["txt"]), "\n").alias("_own"))
        rows, content = found.select("rec_id").join(own, "rec_id"), F.col("_own")
    if syntax == "html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            content = F.replace(content, F.lit(a), F.lit(b))
    elif syntax == "json":
        content = F.to_json(F.struct(F.col("rec_id"), content.alias("content")))
    return rows.select("rec_id", content.alias("content"))


def report(found: DataFrame, c: Collection, style: str = "tab") -> DataFrame:
    """``(rec_id, line)``: a line for each result: terse (key), tab, json or xml."""
    rows = headline(found.join(c.described().select("rec_id", "key", "file_name"), "rec_id"), c)
    fields: Mapping[str, Column] = {
        "score": F.round("score", 4).cast("string"), "key": F.coalesce("key", F.lit("")), "file": F.coalesce("file_name", F.lit("")),
        "hits": F.col("hit_count").cast("string"), "headline": F.coalesce("headline", F.lit("")),
    }
    if style == "terse":
        line = fields["key"]
    elif style == "tab":
        line = F.concat_ws("\t", *[F.regexp_replace(v, r"[\t\n]", " ") for v in fields.values()])
    elif style == "json":
        line = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    elif style == "xml":
        line = F.to_xml(F.struct(*[v.alias(k) for k, v in fields.items()]), {"rowTag": "result"})
    else:
        raise ValueError(f"no such style: {style}")
    return rows.select("rec_id", line.alias("line"))


def centroid(c: Collection) -> DataFrame:
    """``(kind, name, freq)``: what a collection tells others of itself: its fields with their entries, and its words."""
    words = c.vocabulary().select(F.lit("word").alias("kind"), F.col("term").alias("name"), F.col("tf").cast("long").alias("freq"))
    if c.extents is None:
        return words
    fields = c.extents.groupBy("path").agg(F.count(F.lit(1)).alias("freq"))
    return words.unionByName(fields.select(F.lit("field").alias("kind"), F.col("path").alias("name"), "freq"))
