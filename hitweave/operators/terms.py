"""Leaves of a query: words, truncations, globs, phrases and sounds."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import HITS, Collection
from ..functions import phonetic
from ..functions.text import matches_glob
from .results import no_hits, result


def _one(df: DataFrame, src: int) -> DataFrame:
    """Postings of a single word: one row for each record already."""
    hits = F.transform("hits", lambda h: F.struct(h["start"].cast("long").alias("start"), h["end"].cast("long").alias("end"), F.lit(src).alias("src")))
    return result(df, hit_count=F.col("tf"), hits=hits)


def _many(df: DataFrame, src: int) -> DataFrame:
    """Postings of several words, brought together by record."""
    rows = df.groupBy("rec_id").agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list("hits")).alias("hits"))
    return _one(rows, src)


#: Words that are asked for by name at most; beyond them the whole index is read.
NAMED = 1000


def _matching(c: Collection, keep: Column) -> DataFrame:
    """Postings of the words that stand a test.

    The words are found in the vocabulary, where it is written, and asked for by name, so that
    only row groups with one of them are read; where there are many, the index is filtered.
    """
    if c.words is not None:
        some = [r.term for r in c.vocabulary().where(keep).select("term").take(NAMED + 1)]
        if len(some) <= NAMED:
            return c.posted(*some) if some else c.postings.where("false")
    return c.postings.where(keep)


def term(c: Collection, word: str, src: int = 0) -> DataFrame:
    """Records with the word, in any case; the word's alias where it has one, nothing for a stopword."""
    word = c.aliases.get(word.lower(), word.lower())
    return _one(c.postings.where("false") if word in c.stopwords else c.posted(word), src)


def prefix(c: Collection, start: str, src: int = 0) -> DataFrame:
    """Right truncation: words that start so; two characters at least."""
    _long_enough(start, 2)
    return _many(c.postings.where(F.col("term").startswith(start.lower())), src)


def suffix(c: Collection, end: str, src: int = 0) -> DataFrame:
    """Left truncation: words that end so; three characters at least."""
    _long_enough(end, 3)
    return _many(_matching(c, F.col("term").endswith(end.lower())), src)


def containing(c: Collection, part: str, src: int = 0) -> DataFrame:
    """Truncation on both sides; three characters at least."""
    _long_enough(part, 3)
    return _many(_matching(c, F.col("term").contains(part.lower())), src)


def glob(c: Collection, pattern: str, src: int = 0) -> DataFrame:
    """Words that match a glob."""
    return _many(_matching(c, matches_glob(F.col("term"), pattern.lower())), src)


def _long_enough(text: str, least: int) -> None:
    if len(text) < least:
        from ..plans.errors import QueryError

        raise QueryError(9, f"truncated term too short: {text!r}")


def _standing(batches, keep):
    """Of ``(rec_id, text, hits)`` the hits that stand a test; a text is gone through once, however many hits it has."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        hits = batch.column(2)
        flat, ends = hits.flatten(), np.concatenate([[0], np.cumsum(hits.value_lengths().to_numpy(zero_copy_only=False))])
        starts, lasts = flat.field("start").to_numpy(), flat.field("end").to_numpy()
        stay = np.zeros(len(flat), bool)
        for n, text in enumerate(batch.column(1)):
            own = text.as_py()
            for i in range(ends[n], ends[n + 1]):
                stay[i] = keep(own, starts[i], lasts[i])
        kept = np.concatenate([[0], np.cumsum(stay)])[ends].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(kept), flat.filter(pa.array(stay)))], ["rec_id", "hits"])


def _checked(c: Collection, df: DataFrame, keep: Callable[[str, int, int], bool]) -> DataFrame:
    """Hits of ``df`` that stand a test on the record's text and the hit's first and last character."""
    rows = df.select("rec_id", "hits").join(c.records.select("rec_id", "text"), "rec_id").select("rec_id", "text", "hits")
    kept = rows.mapInArrow(lambda b: _standing(b, keep), f"rec_id long, hits {HITS}")
    return result(kept.where(F.size("hits") > 0), hit_count=F.size("hits"), hits=F.col("hits"))


def case_term(c: Collection, word: str, src: int = 0) -> DataFrame:
    """``word=``: the word as written, case and all."""
    return _checked(c, term(c, word, src), lambda text, start, _: text.startswith(word, start))


def case_prefix(c: Collection, start: str, src: int = 0) -> DataFrame:
    """``word=*``: words that start as written."""
    return _checked(c, prefix(c, start, src), lambda text, at, _: text.startswith(start, at))


def exact_term(c: Collection, word: str, src: int = 0) -> DataFrame:
    """``word.``: the word as a whole token, not joined to others by ``- _ . ,`` or an apostrophe."""
    before, after = re.compile(r"[\w.,'_-]", re.ASCII), re.compile(r"[\w_-]|[.,']\w", re.ASCII)

    def alone(text: str, start: int, end: int) -> bool:
        return not (start and before.match(text, start - 1)) and not after.match(text, end + 1)

    return _checked(c, term(c, word, src), alone)


def phrase(c: Collection, words: Sequence[str], src: int = 0) -> DataFrame:
    """The words one after the other.

    Rows of the phrase's words are brought together by record; only records
    with all of them go on, and the places of the words are met from the first
    word on, each by its number in the record.
    """
    words = [w.lower() for w in words]
    if len(words) == 1:
        return term(c, words[0], src)
    distinct = sorted(set(words))
    rows = c.posted(*distinct).groupBy("rec_id").agg(
        *[F.flatten(F.collect_list(F.when(F.col("term") == w, F.col("hits")))).alias(f"w{n}") for n, w in enumerate(distinct)]
    )
    for n in range(len(distinct)):
        rows = rows.where(F.size(f"w{n}") > 0)
    ords = {w: F.transform(f"w{n}", lambda h: h["ord"]) for n, w in enumerate(distinct)}
    ends = F.map_from_arrays(ords[words[-1]], F.transform(f"w{distinct.index(words[-1])}", lambda h: h["end"]))
    starts = ords[words[0]]
    for n, w in enumerate(words[1:], 1):
        starts = F.transform(F.array_intersect(F.transform(starts, _plus(n)), ords[w]), _plus(-n))
    first = F.map_from_arrays(ords[words[0]], F.transform(f"w{distinct.index(words[0])}", lambda h: h["start"]))
    hits = F.transform(
        F.array_sort(starts),
        lambda o: F.struct(
            F.element_at(first, o).cast("long").alias("start"), F.element_at(ends, o + len(words) - 1).cast("long").alias("end"), F.lit(src).alias("src")
        ),
    )
    got = rows.select("rec_id", hits.cast(HITS).alias("hits")).where(F.size("hits") > 0)
    return result(got, hit_count=F.size("hits"), hits=F.col("hits"))


def _plus(n: int):
    return lambda x: x + n


def compound(c: Collection, words: Sequence[str], src: int = 0) -> DataFrame:
    """The phrase, or where no record has it the words as one (``data base``: ``database``)."""
    found = phrase(c, words, src)
    return term(c, "".join(words), src) if found.isEmpty() else found


def sounding(c: Collection, word: str, method: str = "metaphone", src: int = 0) -> DataFrame:
    """``word#``: words that sound alike, by Soundex or by the Metaphone codes.

    The codes of the vocabulary are compared.
    """
    if method == "soundex":
        same = F.soundex("term") == F.soundex(F.lit(word.lower()))
        return _many(_matching(c, same & F.col("term").rlike("^[a-z]")), src)
    one, two = phonetic.metaphones_text(word)
    codes = [x for x in {one, two} if x]
    if not codes:
        return _many(c.postings.where("false"), src)
    same = F.arrays_overlap(phonetic.metaphones(F.col("term")), F.array(*map(F.lit, codes)))
    if c.words is not None:
        return _many(_matching(c, same), src)
    # without a vocabulary the codes of each different word are made once
    return _many(c.postings.join(c.vocabulary().select("term").where(same), "term"), src)


def fuzzy(c: Collection, word: str, most: int | None = None, src: int = 0) -> DataFrame:
    """``word~``: as ``sounding``; with ``most``, words within that many edits."""
    if most is None:
        return sounding(c, word, src=src)
    return _many(_matching(c, F.levenshtein(F.col("term"), F.lit(word.lower()), most) >= 0), src)


def free_form(found: DataFrame) -> DataFrame:
    """``word$``: without the places of the hits."""
    return found.withColumn("hits", no_hits())


def weighted(found: DataFrame, weight: float) -> DataFrame:
    """``word:N``: the scores times N, which may be negative."""
    return found.withColumn("score", F.col("score") * F.lit(float(weight)))


def by_meta(c: Collection, column: str, pattern: str, fold: bool = False) -> DataFrame:
    """Records whose key, file name, doctype or other metadata matches a glob; no hits."""
    return result(c.described().where(matches_glob(F.col(column), pattern, fold)).select("rec_id"))
