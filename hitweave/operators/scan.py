"""Browsing: words and values with their frequencies, facets, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions import phonetic
from ..functions.text import glob_to_regex
from .structural import of_field


def _wanted(term: Column, pattern: str | None, method: str) -> Column:
    ok = F.length(term) > 1
    if pattern is None:
        return ok
    if method == "soundex":
        return ok & (F.soundex(term) == F.soundex(F.lit(pattern)))
    if method == "metaphone":
        return ok & F.arrays_overlap(phonetic.metaphones(term), F.array(*[F.lit(x) for x in set(phonetic.metaphones_text(pattern)) if x]))
    parts = [F.lit(False)]
    for one in pattern.lower().split("|"):
        parts.append(term.rlike(glob_to_regex(one)) if any(c in one for c in "*?[{") else term.startswith(one))
    any_ = parts[0]
    for p in parts[1:]:
        any_ |= p
    return ok & any_


def terms(c: Collection, pattern: str | None = None, method: str = "", field: str | None = None) -> DataFrame:
    """``(term, freq)``: words of two letters or more; ``pattern``: a prefix, a glob, or several parted by ``|``; in a field if given."""
    wanted = _wanted(F.col("term"), pattern, method)
    if c.stopwords:
        wanted &= ~F.col("term").isin(*c.stopwords)
    if field is None:
        return c.vocabulary().where(wanted).select("term", F.col("tf").cast("long").alias("freq"))
    rows = c.postings.where(wanted)
    own = of_field(c.extents, field).groupBy("rec_id").agg(F.collect_list(F.struct("f_start", "f_end")).alias("_ext"))
    inside = F.filter("hits", lambda h: F.exists("_ext", lambda e: (h["start"] >= e["f_start"]) & (h["end"] <= e["f_end"])))
    return rows.join(own, "rec_id").select("term", F.size(inside).alias("n")).where("n > 0").groupBy("term").agg(F.sum("n").cast("long").alias("freq"))


def values(extents: DataFrame, field: str, column: str = "num") -> DataFrame:
    """``(value, freq)`` of a typed field: its numbers, dates or texts."""
    return of_field(extents, field).where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def facets(found: DataFrame, extents: DataFrame, field: str, words: bool = False) -> DataFrame:
    """``(value, freq)``: the field's contents in the records found, whole or word by word."""
    rows = of_field(extents, field).join(found.select("rec_id"), "rec_id", "left_semi").where(F.col("txt").isNotNull())
    value = F.explode(F.regexp_extract_all(F.lower("txt"), F.lit("([a-z0-9]+)"), 1)) if words else F.col("txt")
    return rows.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("freq"))


def term_statistics(c: Collection) -> DataFrame:
    """One row: words in all, different words, records, records with any word."""
    total = c.vocabulary().agg(F.sum("tf").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))
    return total.crossJoin(c.described().agg(F.count(F.lit(1)).alias("n_records")))


def field_statistics(extents: DataFrame) -> DataFrame:
    """``(field, entries, records, expectation)``: the last is ln(1 + entries), by which operands are ordered."""
    return extents.groupBy("field").agg(F.count(F.lit(1)).alias("entries"), F.approx_count_distinct("rec_id", 0.01).alias("records"), F.log1p(F.count(F.lit(1))).alias("expectation"))


def merged(*lists: DataFrame, how: str = "sum") -> DataFrame:
    """Term lists as one: frequencies summed, or the largest."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("term").agg((F.sum("freq") if how == "sum" else F.max("freq")).alias("freq"))
