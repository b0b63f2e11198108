"""Laws of the algebra, and small fixtures against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from hitweave.collection import Collection, extents, records
from hitweave.operators import positional, reducers, scoring, sets, sorting, structural, terms, typed
from hitweave.plans import Engine, QueryError

TEXTS = {
    1: "alpha beta gamma", 2: "beta, alpha; alpha", 3: "gamma delta alpha - beta", 4: "", 5: "delta delta delta", 6: "Alpha x x x x x x x x x x x x x x x x x x x x x beta",
    7: "alphabet beta", 8: "the domain alpha.beta", 9: None, 10: "beta alpha beta alpha beta",
}


@pytest.fixture(scope="module")
def c(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "i long, t string")
    recs = records(df, "i", "t", key=F.concat(F.lit("k"), F.col("i").cast("string")), category=F.col("i") % 3, date=F.timestamp_seconds(F.col("i") * 86_400))
    return Collection.of(recs)


def ids(df):
    return {r.rec_id for r in df.collect()}


def places(word, text):
    import re

    return [(m.start(), m.end() - 1) for m in re.finditer(r"[a-z0-9]+", (text or "").lower()) if m.group() == word]


def has(word):
    return {i for i, t in TEXTS.items() if places(word, t)}


def test_laws(c):
    e = Engine(c)
    a, b = e.compile("alpha"), e.compile("beta")
    A, B, everything = has("alpha"), has("beta"), set(TEXTS)
    assert ids(a) == A and ids(sets.and_(a, a)) == A and ids(sets.or_(a, b)) == A | B
    assert ids(sets.andnot(a, b)) | ids(sets.and_(a, b)) == A
    assert ids(sets.xor(a, b)) == (A - B) | (B - A) == ids(sets.or_(sets.andnot(a, b), sets.notand(a, b)))
    assert ids(sets.not_(c.records, a)) == everything - A and ids(sets.not_(c.records, sets.not_(c.records, a))) == A
    assert ids(sets.nor(c.records, a, b)) == everything - (A | B) and ids(sets.nand(c.records, a, b)) == everything - (A & B)
    assert ids(sets.xnor(c.records, a, b)) == everything - (A ^ B)
    assert ids(sets.promote(a, b)) == B == ids(sets.demote(a, b))
    scores = {r.rec_id: r.score for r in b.collect()}
    for r in sets.demote(a, sets.promote(a, b)).collect():
        assert abs(r.score - scores[r.rec_id]) < 1e-12


def test_maybe(c):
    e = Engine(c)
    assert ids(e.compile("alpha beta MAYBE")) == has("alpha") & has("beta")
    assert ids(e.compile("domain delta MAYBE")) == has("delta") == ids(e.compile("delta domain MAYBE"))
    assert ids(e.compile("nothing beta MAYBE")) == has("beta") == ids(e.compile("beta nothing MAYBE"))
    assert ids(e.compile("nothing nobody MAYBE")) == set()


def gaps(a, b):
    """The gap of two places, None where they overlap."""
    g = max(a[0], b[0]) - (a[1] if a[0] <= b[0] else b[1]) - 1
    return g


@pytest.mark.parametrize("text,test", [
    ("NEAR:3", lambda a, b: 0 <= gaps(a, b) <= 3), ("ADJ", lambda a, b: 0 <= gaps(a, b) <= 3), ("BEFORE:4", lambda a, b: 0 <= gaps(a, b) <= 4 and a < b),
    ("AFTER:2", lambda a, b: 0 <= gaps(a, b) <= 2 and a > b), ("FOLLOWS", lambda a, b: 0 <= gaps(a, b) <= 4 and a > b), ("PRECEDES", lambda a, b: 0 <= gaps(a, b) <= 4 and a < b),
    ("DIST>=10", lambda a, b: gaps(a, b) >= 10), ("DIST<2", lambda a, b: 0 <= gaps(a, b) < 2), ("PROX:-20", lambda a, b: gaps(a, b) >= 20), ("NEAR", lambda a, b: 0 <= gaps(a, b) <= 50),
    ("FAR", lambda a, b: gaps(a, b) >= 50),
])
def test_proximity(c, text, test):
    want = {}
    for i, t in TEXTS.items():
        n = sum(test(a, b) for a, b in itertools.product(places("alpha", t), places("beta", t)))
        if n:
            want[i] = n
    assert {r.rec_id: r.hit_count for r in Engine(c).compile(f"alpha beta {text}").collect()} == want


def test_phrases(c):
    e = Engine(c)
    assert ids(e.compile('"alpha beta"')) == {1, 3, 6, 8, 10} - {6}
    assert {r.rec_id: r.hit_count for r in e.compile('"beta alpha"').collect()} == {2: 1, 10: 2}
    assert {r.rec_id: r.hit_count for r in e.compile('"delta delta"').collect()} == {5: 2}
    assert ids(terms.compound(c, ["alpha", "bet"])) == {7} and ids(terms.compound(c, ["alpha", "beta"])) == {1, 3, 8, 10}


def test_term_forms(c):
    e = Engine(c)
    assert ids(e.compile("alph*")) == has("alpha") | {7} and ids(e.compile("*eta")) == has("beta") and ids(e.compile("*lph*")) == has("alpha") | {7}
    assert ids(e.compile("Alpha=")) == {6} and ids(e.compile("alpha=")) == has("alpha") - {6} and ids(e.compile("Al=*")) == {6}
    assert 8 not in ids(e.compile("alpha.")) and 1 in ids(e.compile("alpha."))
    assert ids(e.compile("?elta")) == has("delta") and ids(e.compile("{alpha,delta}")) == has("alpha") | has("delta")
    assert ids(e.compile("KEY:k1*")) == {1, 10} and ids(e.compile("alpha WITHKEY:k1*")) == {1, 10}
    assert ids(e.compile("alpha WITHIN:1970-01-02..1970-01-03")) == {1, 2}
    for bad, code in (("a*", 9), ("*ab", 9), ("alpha AND", 108), ("", 108), ("alpha beta XPEER", 114), ("alpha BOOST", 108), ("alpha@", 110), ("f/x", 114)):
        with pytest.raises(QueryError) as x:
            e.compile(bad)
        assert x.value.code == code, bad


def test_reducers(c):
    e = Engine(c)
    q = e.compile("alpha beta OR delta OR")
    aux = {r.rec_id: r.aux_count for r in q.collect()}
    assert ids(reducers.reduce(q, 2)) == {i for i, n in aux.items() if n >= 2} and ids(reducers.reduce(q, 9)) == set()
    assert ids(reducers.focus(q, 9)) == {i for i, n in aux.items() if n == max(aux.values())} == ids(reducers.reduce(q, 0))
    assert ids(reducers.focus(q, 2)) == ids(reducers.reduce(q, 2))
    assert reducers.trim(q, 3).count() == 3 and reducers.trim(q, 0).count() == 0
    assert ids(reducers.hit_count(q, 3)) == {r.rec_id for r in q.collect() if r.hit_count >= 3}
    assert ids(reducers.hit_count(q, -2)) == {r.rec_id for r in q.collect() if r.hit_count <= 2}


def test_models_give_numbers(c):
    e = Engine(c)
    for method in scoring.METHODS:
        got = scoring.score(e.compile("alpha"), c, method, recency=1.0, pivot=1971.0).collect()
        assert {r.rec_id for r in got} == has("alpha") and all(r.score == r.score for r in got)
    with pytest.raises(ValueError):
        scoring.score(e.compile("alpha"), c, "unknown")
    assert abs(sum(r.score for r in scoring.score(e.compile("alpha"), c, "l1").collect()) - 1) < 1e-9
    assert abs(sum(r.score**2 for r in e.compile("alpha").collect()) - 1) < 1e-9
    s = scoring.scaled(e.compile("alpha")).collect()
    assert min(r.scaled for r in s) == 1 and max(r.scaled for r in s) == 100


def brute_news(hours):
    """The recency weight, read from its tables."""
    if -18 < hours < 0:
        hours = 2
    days = int(hours / 24)
    w = -7.0 if days == -1 else days * 6.0 if days < 0 else 10.0 if days == 0 else 1.0
    w += sum(x for d, x in sorting.NEWS_DAYS if days <= d)
    return w * next((x for h, x in sorting.NEWS_HOURS if hours <= h), 1.0)


def test_news_weight(spark):
    hours = [-100, -30, -20, -18, -17, -1, 0, 1, 2, 3, 4, 5, 8, 9, 12, 13, 16, 20, 23, 24, 25, 47, 48, 72, 100, 168, 169, 400, 600, 1500, 2500, 7300, 99_999]
    df = spark.createDataFrame([(h,) for h in hours], "h long")
    for r in df.select("h", sorting.news_weight(F.col("h")).alias("w")).collect():
        assert abs(r.w - brute_news(r.h)) < 1e-9, r.h


def test_orders(c):
    e = Engine(c)
    q = e.compile("alpha beta OR")
    rows = q.collect()
    by = lambda name: [r.rec_id for r in sorting.sort(q, c, name).collect()]
    assert by("score") == [r.rec_id for r in sorted(rows, key=lambda r: (-r.score, -r.rec_id))]
    assert by("hits") == [r.rec_id for r in sorted(rows, key=lambda r: (-r.hit_count, -r.score, -r.rec_id))]
    assert by("index") == sorted(r.rec_id for r in rows) and by("date") == sorted((r.rec_id for r in rows), reverse=True)
    assert by("key") == sorted((r.rec_id for r in rows), key=lambda i: f"k{i}", reverse=True)
    with pytest.raises(ValueError):
        by("nothing")
    keys = sorted(f"k{i}" for i in TEXTS)
    for r in sorting.neighbours(c).collect():
        at = keys.index(r.key)
        assert (r.prev_key, r.next_key) == (keys[at - 1] if at else None, keys[at + 1] if at + 1 < len(keys) else None)


# --- containers --------------------------------------------------------------------------------------------------------------------------


def tree(rng, n):
    """A text of words with nested extents: (path, start, end, depth)."""
    text, exts = "", []

    def grow(path, depth):
        nonlocal text
        start = len(text)
        for k in range(rng.randint(1, 3)):
            if depth < 3 and rng.random() < 0.6:
                grow(f"{path}/{rng.choice('pqr')}", depth + 1)
            else:
                text += rng.choice(["aa ", "bb ", "cc "])
        exts.append((path, start, len(text) - 1, depth))

    grow("root", 0)
    return text, exts


@pytest.fixture(scope="module")
def nested(spark):
    rng = random.Random(4)
    docs = {n: tree(rng, n) for n in range(60)}
    df = spark.createDataFrame([(n, t) for n, (t, _) in docs.items()], "i long, t string")
    rows = spark.createDataFrame([(n, *x) for n, (_, xs) in docs.items() for x in xs], "rec_id long, path string, s long, e long, depth int")
    exts = extents(rows, F.element_at(F.split("path", "/"), -1), rec_id="rec_id", path="path", depth="depth", f_start="s", f_end="e")
    return docs, Collection.of(records(df, "i", "t"), exts)


def innermost(hit, exts):
    around = [(e - s, -d, p, s) for p, s, e, d in exts if s <= hit[0] and hit[1] <= e]
    return min(around, default=None)


def test_containers(nested):
    docs, c = nested
    e = Engine(c)

    def want(test):
        out = {}
        for n, (t, xs) in docs.items():
            k = sum(test(a, b, xs) for a, b in itertools.product(places("aa", t), places("bb", t)))
            if k:
                out[n] = k
        return out

    def got(q):
        return {r.rec_id: r.hit_count for r in e.compile(q).collect()}

    same = lambda a, b, xs: innermost(a, xs) == innermost(b, xs)
    inside = lambda h, x: x[1] <= h[0] and h[1] <= x[2]
    assert got("aa bb PEER") == want(same) and got("aa bb PEERb") == want(lambda a, b, xs: same(a, b, xs) and a <= b)
    assert got("aa bb PEERa") == want(lambda a, b, xs: same(a, b, xs) and a >= b)
    assert got("aa bb XPEER") == want(lambda a, b, xs: not same(a, b, xs)) == got("aa bb FAR")
    assert got("aa bb ANCESTOR") == want(lambda a, b, xs: any(inside(a, x) and inside(b, x) for x in xs if x[3] > 0))
    assert got("aa bb AND:p") == want(lambda a, b, xs: any(inside(a, x) and inside(b, x) for x in xs if x[0].endswith("p")))
    assert set(got("aa bb PEER")) <= set(got("aa bb AND")) and got("aa bb AND SIBLING") == got("aa bb PEER")
    for q, keep in (("aa WITHIN:p", any), ("aa INCLUSIVE:p", all)):
        assert set(got(q)) == {n for n, (t, xs) in docs.items() if places("aa", t) and keep(any(inside(h, x) for x in xs if x[0].endswith("p")) for h in places("aa", t))}
    assert set(got("aa WITHIN:p")) | set(got("aa XWITHIN:p")) == set(got("aa")) and not set(got("aa WITHIN:p")) & set(got("aa XWITHIN:p"))
    assert set(got("aa NOT:p")) == {n for n, (t, xs) in docs.items() if not places("aa", t) and any(x[0].endswith("p") for x in xs)}
    assert got("p/aa") == got("aa WITHIN:p")


# --- typed fields ---------------------------------------------------------------------------------------------------------------------------


def test_boxes_by_points(spark):
    """Overlap and score of random boxes against their areas."""
    rng = random.Random(9)
    rows = []
    for n in range(200):
        s, w = rng.uniform(-80, 60), rng.uniform(-180, 180)
        rows.append((n, s + rng.uniform(1, 20), w, s, (w + rng.uniform(1, 40) + 180) % 360 - 180))
    df = spark.createDataFrame(rows, "rec_id long, n double, w double, s double, e double")
    qn, qw, qs, qe = 30.0, 150.0, -30.0, -150.0
    want = {}
    for i, n, w, s, e in rows:
        e2 = e + 360 if e < w else e
        h = min(n, qn) - max(s, qs)
        v = max(min(e2 + t, qe + 360) - max(w + t, qw) for t in (-360, 0, 360))
        if h >= 0 and v >= 0:
            want[i] = (h / (n - s) * (v / (e2 - w)) * (h / 60) * (v / 60)) ** 0.5
    got = {r.rec_id: r.score for r in typed.boxes(df, qn, qw, qs, qe).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_dates_with_precision(spark):
    spans = {1: ("1999-01-01", "1999-12-31"), 2: ("1999-06-01", "1999-06-30"), 3: ("1998-01-01", "2001-01-01"), 4: ("2000-02-29", None), 5: (None, None)}
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in spans.items()], "i long, a string, b string")
    exts = extents(df, "d", rec_id="i", ts_lo=F.col("a").cast("timestamp"), ts_hi=F.col("b").cast("timestamp"))
    for name in typed.DATE_RELATIONS:
        qs, qe = "1999-06-01", "1999-06-30"
        want = set()
        for i, (a, b) in spans.items():
            if a is None:
                continue
            b = b or a
            ok = {
                "before": a < qs, "before_strict": b < qs, "before_during": a <= qe, "before_during_strict": b <= qe, "during": qs <= a <= qe or qs <= b <= qe,
                "during_strict": qs < a < qe and qs < b < qe, "during_after": b >= qs, "during_after_strict": a >= qs, "after": b > qe, "after_strict": a > qe,
            }[name]
            want |= {i} if ok else set()
        assert ids(typed.dated(exts, "d", name, qs, qe)) == want, name
    assert ids(typed.dated(exts, "d", "<>", "1999-06-15")) == {4}


def test_key_join(spark):
    left = records(spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", None)], "i long, t string, k string"), "i", "t", key="k")
    right = records(spark.createDataFrame([(7, "y", "a"), (8, "y", "a"), (9, "y", "c")], "i long, t string, k string"), "i", "t", key="k")
    one, two = Collection.of(left), Collection.of(right)
    e = Engine(one, other={"two": Engine(two)})
    assert ids(e.compile("x y JOIN:two")) == {1} and ids(e.compile("x y JOINr:two")) == {7, 8}
    assert ids(e.compile("x x JOIN")) == {1, 2, 3}
