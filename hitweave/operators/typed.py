"""Predicates on typed fields.  A record is found if an instance of the field is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..collection import HITS
from ..functions import text as T
from .reducers import relation
from .results import result
from .structural import of_field


def _found(rows: DataFrame) -> DataFrame:
    hits = F.collect_list(F.when(F.col("f_start").isNotNull(), F.struct(F.col("f_start").alias("start"), F.col("f_end").alias("end"), F.lit(0).alias("src"))))
    got = rows.groupBy("rec_id").agg(F.count(F.lit(1)).alias("_n"), hits.cast(HITS).alias("_hits"))
    return result(got, hit_count=F.col("_n"), hits=F.col("_hits"))


def _upper(how: str, value: Column) -> Column:
    """A relation of a range's end, or of the number where it is none; in a form that the scan can use."""
    test = relation(how)
    return test(F.col("num_hi"), value) | (F.col("num_hi").isNull() & test(F.col("num"), value))


def numeric(extents: DataFrame, field: str, how: str, value: float) -> DataFrame:
    """A relation to a number; ``<>``: records that have the field without an equal value.  For range fields: ranges that hold a number in relation."""
    own = of_field(extents, field).where(F.col("num").isNotNull())
    lit = F.lit(float(value))
    same = (F.col("num") <= lit) & _upper(">=", lit)
    if how in ("<>", "!="):
        return _found(own.join(own.where(same).select("rec_id"), "rec_id", "left_anti"))
    if how in ("=", "=="):
        return _found(own.where(same))
    return _found(own.where(_upper(how, lit) if how in (">", ">=") else relation(how)(F.col("num"), lit)))


def interval(extents: DataFrame, field: str, low: float, high: float) -> DataFrame:
    """Numbers, or ranges, that meet ``[low, high]``."""
    own = of_field(extents, field)
    return _found(own.where((F.col("num") <= F.lit(float(high))) & _upper(">=", F.lit(float(low)))))


def hashed(extents: DataFrame, field: str, value: str, kind: str = "hash") -> DataFrame:
    """Hash, casehash and lexi fields: instances whose code is that of the value."""
    code = {"hash": T.exact_hash, "casehash": T.case_hash, "lexi": T.lexi}[kind]
    return _found(of_field(extents, field).where(code(F.col("txt")) == code(F.lit(value))))


def truth(extents: DataFrame, field: str, value: bool) -> DataFrame:
    from ..functions.values import boolean

    return _found(of_field(extents, field).where(boolean(F.col("txt")) == F.lit(value)))


def money(extents: DataFrame, field: str, how: str, value: str) -> DataFrame:
    """A relation between amounts, compared as decimals."""
    from ..functions.values import currency

    own = of_field(extents, field).withColumn("_amount", currency(F.col("txt"))).where("_amount is not null")
    return _found(own.where(relation(how)(F.col("_amount"), currency(F.lit(value)))))


#: Relations of a target [ts, te] to a query [qs, qe].
DATE_RELATIONS = {
    "before": lambda ts, te, qs, qe: ts < qs,
    "before_strict": lambda ts, te, qs, qe: te < qs,
    "before_during": lambda ts, te, qs, qe: ts <= qe,
    "before_during_strict": lambda ts, te, qs, qe: te <= qe,
    "during": lambda ts, te, qs, qe: ((ts >= qs) & (ts <= qe)) | ((te >= qs) & (te <= qe)),
    "during_strict": lambda ts, te, qs, qe: (ts > qs) & (ts < qe) & (te > qs) & (te < qe),
    "during_after": lambda ts, te, qs, qe: te >= qs,
    "during_after_strict": lambda ts, te, qs, qe: ts >= qs,
    "after": lambda ts, te, qs, qe: te > qe,
    "after_strict": lambda ts, te, qs, qe: ts > qe,
}
#: The same for a single date q.
DATE_SINGLE = {
    "before": lambda ts, te, q: ts < q,
    "before_strict": lambda ts, te, q: te < q,
    "before_during": lambda ts, te, q: ts <= q,
    "before_during_strict": lambda ts, te, q: te <= q,
    "during": lambda ts, te, q: (ts <= q) & (te >= q),
    "during_strict": lambda ts, te, q: (te <= q) & (ts >= q),
    "during_after": lambda ts, te, q: te >= q,
    "during_after_strict": lambda ts, te, q: ts >= q,
    "after": lambda ts, te, q: te > q,
    "after_strict": lambda ts, te, q: ts > q,
}
#: Symbols as relations.
DATE_SYMBOLS = {"<": "before", "<=": "before_during", "=": "during", "==": "during", ">=": "during_after", ">": "after"}


def dated(extents: DataFrame, field: str, how: str, low: str, high: str | None = None) -> DataFrame:
    """A date relation between the field's instances and a date, or a range with ``high``; ``<>``: without any that is during it."""
    own = of_field(extents, field).where(F.col("ts_lo").isNotNull())
    ts, te = F.col("ts_lo"), F.coalesce("ts_hi", "ts_lo")
    qs = F.lit(low).cast("timestamp")

    def test(name: str) -> Column:
        if high is None:
            return DATE_SINGLE[name](ts, te, qs)
        return DATE_RELATIONS[name](ts, te, qs, F.lit(high).cast("timestamp"))

    if how in ("<>", "!="):
        return _found(own.join(own.where(test("during")).select("rec_id"), "rec_id", "left_anti"))
    name = DATE_SYMBOLS.get(how, how)
    if high is not None and how == "<=":
        name = "before_during_strict"
    return _found(own.where(test(name)))


def boxes(found: DataFrame, n: float, w: float, s: float, e: float) -> DataFrame:
    """Of ``(rec_id, n, w, s, e)`` those that overlap the box, with the spatial score.

    A box whose east is less than its west crosses the date line; 360 is added
    to its east, and boxes are met a turn to either side as well.  The score is the
    square root of the shares of overlap in the target and in the query.
    """

    def span(lo: Column, hi: Column, qlo: float, qhi: float) -> Column:
        return F.greatest(F.least(hi, F.lit(qhi)) - F.greatest(lo, F.lit(qlo)), F.lit(-1.0))

    query_e = e + 360 if e < w else e
    east = F.when(F.col("e") < F.col("w"), F.col("e") + 360).otherwise(F.col("e"))
    width = F.greatest(*[span(F.col("w") + turn, east + turn, w, query_e) for turn in (-360, 0, 360)])
    height = span(F.col("s"), F.col("n"), s, n)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(1.0)

    target = share(width, east - F.col("w")) * share(height, F.col("n") - F.col("s"))
    query = share(width, F.lit(float(query_e - w))) * share(height, F.lit(float(n - s)))
    rows = found.withColumn("_w", width).withColumn("_h", height).withColumn("_score", F.sqrt(target * query)).where("_w >= 0 and _h >= 0")
    return result(rows.groupBy("rec_id").agg(F.sum("_score").alias("_s"), F.count(F.lit(1)).alias("_n")), score=F.col("_s"), hit_count=F.col("_n"))


def boxed(extents: DataFrame, field: str, n: float, w: float, s: float, e: float) -> DataFrame:
    """A box field: instances, written ``N,W,S,E``, that overlap the box."""
    from ..functions.values import box

    own = of_field(extents, field).select("rec_id", box(F.col("txt")).alias("b")).where("b is not null")
    return boxes(own.select("rec_id", "b.*"), n, w, s, e)


def phonetic(extents: DataFrame, field: str, words: list[str], method: str = "soundex") -> DataFrame:
    """A phonetic field: instances in which each word sounds like one, by Soundex or Metaphone; an initial stands for what starts with it."""
    if method == "metaphone":
        from ..functions.phonetic import metaphones_text

        @F.udf("boolean", useArrow=True)
        def alike(text: str | None) -> bool:
            own = [set(metaphones_text(x)) - {""} for x in (text or "").split()]
            return all(any(x.lower().startswith(w.lower()) for x in (text or "").split()) if len(w) == 1 else any(set(metaphones_text(w)) & x for x in own) for w in words)

        return _found(of_field(extents, field).where(alike(F.col("txt"))))
    tokens = F.regexp_extract_all(F.lower("txt"), F.lit("([a-z]+)"), 1)
    own = of_field(extents, field).withColumn("_words", tokens)
    for word in words:
        if len(word) == 1:
            ok = F.exists("_words", _starts(word.lower()))
        else:
            ok = F.exists("_words", _sounds(word.lower()))
        own = own.where(ok)
    return _found(own)


def _starts(word: str):
    return lambda x: x.startswith(word)


def _sounds(word: str):
    return lambda x: F.soundex(x) == F.soundex(F.lit(word))
