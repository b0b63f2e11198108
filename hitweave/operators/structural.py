"""Structure: hits in fields, and hits that share a container.

A record's extents stand in one array, grouped once and joined by record; which
of them hold a hit is decided within the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import field_glob, is_glob, matches_glob
from .results import COLUMNS, renamed, result


def of_field(extents: DataFrame, field: str) -> DataFrame:
    """Extents of a field by its name, path, end of a path, or a glob of these; the case and kind of separators don't matter."""
    name = field_glob(field)
    if is_glob(name):
        return extents.where(matches_glob(F.col("field"), name) | matches_glob(F.col("path"), name) | matches_glob(F.col("path"), f"*/{name}"))
    # the last part stands in a column of its own, which the scan can prune by
    last = re.split("[/@]", name)[-1]
    own = extents.where(F.col("field") == last)
    return own if last == name else own.where((F.col("path") == name) | F.col("path").endswith(f"/{name}"))


def _grouped(extents: DataFrame) -> DataFrame:
    one = F.struct((F.col("f_end") - F.col("f_start")).alias("len"), (-F.col("depth")).alias("up"), "path", "f_start", "f_end", F.col("depth"))
    return extents.groupBy("rec_id").agg(F.collect_list(one).alias("_ext"))


def inside(hit: Column, extent: Column) -> Column:
    return (hit["start"] >= extent["f_start"]) & (hit["end"] <= extent["f_end"])


def _in_any(hit: Column) -> Column:
    return F.exists("_ext", lambda e: inside(hit, e))


def within(found: DataFrame, extents: DataFrame, field: str) -> DataFrame:
    """WITHIN, INSIDE: the hits inside of the field; records without any go."""
    rows = found.join(_grouped(of_field(extents, field)), "rec_id").withColumn("hits", F.filter("hits", _in_any)).where(F.size("hits") > 0)
    return rows.withColumn("hit_count", F.size("hits").cast("long")).select(*COLUMNS)


def xwithin(found: DataFrame, extents: DataFrame, field: str) -> DataFrame:
    """XWITHIN: records with no hit in the field."""
    rows = found.join(_grouped(of_field(extents, field)), "rec_id", "left")
    return rows.where(F.col("_ext").isNull() | ~F.exists("hits", _in_any)).select(*COLUMNS)


def inclusive(found: DataFrame, extents: DataFrame, field: str) -> DataFrame:
    """INCLUSIVE: records with all hits in the field."""
    rows = found.join(_grouped(of_field(extents, field)), "rec_id")
    return rows.where((F.size("hits") > 0) & F.forall("hits", _in_any)).select(*COLUMNS)


def not_field(records: DataFrame, found: DataFrame, extents: DataFrame, field: str) -> DataFrame:
    """NOT:field: records that have the field and aren't in the set; their hits are the field's places."""
    own = of_field(extents, field).groupBy("rec_id").agg(
        F.collect_list(F.struct(F.col("f_start").alias("start"), F.col("f_end").alias("end"), F.lit(0).alias("src"))).alias("_hits")
    )
    counts = records.agg(F.count(F.lit(1)).alias("_all")).crossJoin(found.agg(F.count(F.lit(1)).alias("_n")))
    rest = own.join(found.select("rec_id"), "rec_id", "left_anti").crossJoin(F.broadcast(counts))
    return result(rest, score=F.sqrt(F.col("_all") - F.col("_n")) / F.col("_all"), hits=F.col("_hits"))


def container(hit: Column) -> Column:
    """The smallest extent around a hit; of equal ones the deepest, then the first path."""
    return F.array_min(F.filter("_ext", lambda e: inside(hit, e)))


def _paired(left: DataFrame, right: DataFrame, extents: DataFrame, test, tagged: bool) -> DataFrame:
    both = left.join(renamed(right, "r"), "rec_id").join(_grouped(extents), "rec_id")
    if tagged:  # the containers are found once for each hit, not for each pair

        def tag(h: Column) -> Column:
            return F.struct(h["start"].alias("start"), h["end"].alias("end"), h["src"].alias("src"), container(h).alias("c"))

        both = both.withColumn("hits", F.transform("hits", tag)).withColumn("r_hits", F.transform("r_hits", tag))
    # generators keep the optimiser from putting the containers into the test of each pair
    both = both.select("rec_id", "score", "r_score", "_ext", F.explode(F.array(F.struct("hits", "r_hits"))).alias("_h"))
    left_hits, right_hits = F.col("_h.hits"), F.col("_h.r_hits")
    # how many of the right each of the left has: no pair is formed
    partners = F.transform(left_hits, lambda x: F.size(F.filter(right_hits, lambda y: test(x, y))).cast("long"))
    found = both.withColumn("_n", F.explode(F.array(partners))).where(F.exists("_n", lambda n: n > 0))

    def plain(h: Column) -> Column:
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), h["src"].alias("src"))

    mine = F.filter(left_hits, lambda x, i: F.element_at("_n", i + 1) > 0)
    others = F.filter(right_hits, lambda y: F.exists(left_hits, lambda x: test(x, y)))
    hits = F.array_distinct(F.concat(F.transform(mine, plain), F.transform(others, plain)))
    count = F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n)
    return result(found.withColumn("_hits", hits), score=F.col("score") + F.col("r_score"), hit_count=count, aux_count=2, hits=F.col("_hits"))


def _ordered(x: Column, y: Column, order: str | None) -> Column:
    if order == "before":
        return (x["start"] <= y["start"]) & (x["end"] <= y["end"])
    if order == "after":
        return (x["start"] >= y["start"]) & (x["end"] >= y["end"])
    return F.lit(True)


def peer(left: DataFrame, right: DataFrame, extents: DataFrame, order: str | None = None) -> DataFrame:
    """PEER: hits of both in the same innermost container; PEERb and PEERa with the left's before or after.

    ``hit_count`` is the number of such pairs; the scores are added.
    """
    return _paired(left, right, extents, lambda x, y: x["c"].isNotNull() & (x["c"] == y["c"]) & _ordered(x, y, order), True)


def xpeer(left: DataFrame, right: DataFrame, extents: DataFrame) -> DataFrame:
    """XPEER: hits of both in different innermost containers."""
    return _paired(left, right, extents, lambda x, y: x["c"].isNotNull() & y["c"].isNotNull() & (x["c"] != y["c"]), True)


def ancestor(left: DataFrame, right: DataFrame, extents: DataFrame) -> DataFrame:
    """ANCESTOR: hits of both below one element that isn't the record's root."""
    return _paired(left, right, extents.where("depth > 0"), lambda x, y: F.exists("_ext", lambda e: inside(x, e) & inside(y, e)), False)


def and_field(left: DataFrame, right: DataFrame, extents: DataFrame, field: str, order: str | None = None) -> DataFrame:
    """AND:field, and BEFORE:field or AFTER:field with an order: hits of both in one instance of the field."""
    return _paired(
        left, right, of_field(extents, field), lambda x, y: F.exists("_ext", lambda e: inside(x, e) & inside(y, e)) & _ordered(x, y, order), False
    )


def or_field(left: DataFrame, right: DataFrame, extents: DataFrame, field: str) -> DataFrame:
    """OR:field: hits of either in the field."""
    from .sets import or_

    return within(or_(left, right), extents, field)


def around(found: DataFrame, extents: DataFrame, field: str, records: DataFrame) -> DataFrame:
    """``(rec_id, path, f_start, f_end, content)``: the instances of a field that hold a hit (ancestors), with their text."""
    own = of_field(extents, field).select("rec_id", "path", "f_start", "f_end")
    rows = found.select("rec_id", F.explode("hits").alias("h")).join(own, "rec_id").where(inside(F.col("h"), F.struct("f_start", "f_end")))
    rows = rows.select("rec_id", "path", "f_start", "f_end").distinct()
    return rows.join(records.select("rec_id", "text"), "rec_id").select(
        "rec_id", "path", "f_start", "f_end", F.expr("substring(text, cast(f_start + 1 as int), cast(f_end - f_start + 1 as int))").alias("content")
    )


def beside(found: DataFrame, extents: DataFrame, top: str, below: str, records: DataFrame) -> DataFrame:
    """``(rec_id, path, f_start, f_end, content)``: the instances of ``below`` in those instances of ``top`` that hold a hit (descendants)."""
    tops = around(found, extents, top, records).select("rec_id", F.col("f_start").alias("t_start"), F.col("f_end").alias("t_end"))
    rows = of_field(extents, below).join(tops, "rec_id").where("f_start >= t_start and f_end <= t_end").select("rec_id", "path", "f_start", "f_end").distinct()
    return rows.join(records.select("rec_id", "text"), "rec_id").select(
        "rec_id", "path", "f_start", "f_end", F.expr("substring(text, cast(f_start + 1 as int), cast(f_end - f_start + 1 as int))").alias("content")
    )
