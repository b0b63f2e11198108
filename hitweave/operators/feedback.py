"""Queries made from records, sentences and thesauri."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import HITS, Collection
from .results import result
from .structural import of_field
from .terms import NAMED


def by_words(c: Collection, words: DataFrame) -> DataFrame:
    """OR of ``words(term, weight)``: a record's score is the sum of weight times hits over the words it has.

    The words are joined with the postings, so that there may be any number of them; where they are few, they are
    asked for by name as well, and the postings stay where they are.
    """
    some = words.select("term", "weight").take(NAMED + 1)
    if len(some) > NAMED:
        rows = c.postings.join(words, "term")
    elif some:
        rows = c.posted(*{r.term for r in some}).join(F.broadcast(c.spark.createDataFrame(some, words.select("term", "weight").schema)), "term")
    else:
        rows = c.postings.where("false").withColumn("weight", F.lit(0.0))
    rows = rows.withColumn("_n", F.col("tf").cast("long"))
    hits = F.flatten(F.collect_list(F.transform("hits", lambda h: F.struct(h["start"].cast("long").alias("start"), h["end"].cast("long").alias("end"), F.lit(0).alias("src")))))
    got = rows.groupBy("rec_id").agg(F.sum(F.col("weight") * F.col("_n")).alias("_s"), F.sum("_n").alias("_h"), F.count(F.lit(1)).alias("_a"), hits.cast(HITS).alias("_hits"))
    return result(got, score=F.col("_s"), hit_count=F.col("_h"), aux_count=F.col("_a"), hits=F.col("_hits"))


def like_record(c: Collection, source: Collection, rec_id: int, weight: float = 1.0) -> DataFrame:
    """Relevance feedback: the words of a record, each weighted by how often it occurs, against this collection."""
    return by_words(c, _weighed(source, F.col("rec_id") == rec_id, None, weight))


def like_key(c: Collection, source: Collection, key: str, field: str | None = None, weight: float = 1.0) -> DataFrame:
    """As ``like_record`` for the record of a key, by its whole text or by one of its fields."""
    return by_words(c, _weighed(source, F.col("key") == key, field, weight))


def _weighed(source: Collection, which: Column, field: str | None, weight: float) -> DataFrame:
    """``(term, weight)`` of the words of three letters or more in some records, which are read again: the index is sorted by words."""
    rows = source.indexing(source.records.where(which)).where(F.length("term") > 2)
    n = F.col("tf")
    if field is not None:
        own = source.records.where(which).select("rec_id")
        places = of_field(source.extents, field).join(own, "rec_id", "left_semi").groupBy("rec_id").agg(F.collect_list(F.struct("f_start", "f_end")).alias("_ext"))
        rows = rows.join(places, "rec_id")
        n = F.size(F.filter("hits", lambda h: F.exists("_ext", lambda e: (h["start"] >= e["f_start"]) & (h["end"] <= e["f_end"]))))
    return rows.select("term", n.alias("n")).where("n > 0").groupBy("term").agg((F.sum("n") * F.lit(float(weight))).alias("weight"))


def free_words(sentence: str) -> list[tuple[str, bool, float]]:
    """Words of a plain sentence: of three letters or more, truncated if of four or more, weighted by repetition."""
    import re

    out: dict[str, int] = {}
    for word in re.findall(r"[a-z0-9]+", sentence.lower()):
        if len(word) >= 3:
            out[word] = out.get(word, 0) + 1
    return [(w, len(w) >= 4, float(n)) for w, n in out.items()]


def parse_thesaurus(text: str) -> dict[str, list[tuple[str, float]]]:
    """Lines ``parent = child1 + child2:0.5``; ``#`` starts a comment."""
    out: dict[str, list[tuple[str, float]]] = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if "=" not in line:
            continue
        parent, children = line.split("=", 1)
        for child in filter(None, (x.strip() for x in children.split("+"))):
            name, _, weight = child.partition(":")
            out.setdefault(parent.strip().lower(), []).append((name.strip().lower(), float(weight or 1)))
    return out


def parse_stoplist(text: str) -> frozenset[str]:
    """Words parted by white space; ``#`` starts a comment."""
    return frozenset(w.lower() for line in text.splitlines() for w in line.split("#", 1)[0].split())


def expanded(c: Collection, word: str, thesaurus: Mapping[str, list[tuple[str, float]]]) -> DataFrame:
    """OR of a word and its narrower words, each with its weight."""
    children = [(word.lower(), 1.0), *thesaurus.get(word.lower(), [])]
    return by_words(c, c.spark.createDataFrame(children, "term string, weight double"))
