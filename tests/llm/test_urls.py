"""URL filters against a plain reading of the contract."""

import re

from hitweave.llm import urls
from hitweave.llm.queries import op7_url_filter_ngrams

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "://", "http://", "http://A.Example.COM/en/7x?q#f", "https://example.com/en/6", "http://notexample.com/en/7", "http://com/en/", "http://example.net/de/81", "x://de.net/de/8",
    "http://a.org/es/", "http://a.org/ES/", "http://a.org?x=/es/", "http://a.org#/es/", "http://ÄÖ.com/en/", "a://b://c/d", "http://h\n.com/en/7\n/x", "http://example.com/en/7/" + "p" * 100_000,
]


def test_against_plain_reading(spark):
    df = spark.createDataFrame([(n, u, "h", 1.0) for n, u in enumerate(URLS)] + [(3, "://", "h", 1.0)], "page_id long, url string, host string, score double")
    rows = urls.judge(df).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    assert urls.judge(df.limit(0)).count() == 0 and urls.split(URLS[5]) == brute(URLS[5])[:2]


def test_query(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op7_url_filter_ngrams(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))


def test_model_learns_and_generalises():
    held = [x for n, x in enumerate(urls.LABELLED) if n % 4 == 0]
    model = urls.fit([x for n, x in enumerate(urls.LABELLED) if n % 4])
    right = sum((model.score(*urls.split(u)) >= 0.5) == bool(y) for u, y in held)
    assert right >= 0.7 * len(held)
    full = urls.fit(urls.LABELLED)
    assert all((full.score(*urls.split(u)) >= 0.5) == bool(y) for u, y in urls.LABELLED)
    assert urls.fit([]).score("a", "b") == 0.5


def test_training_table(spark):
    df = spark.createDataFrame([(u, y) for u, y in urls.LABELLED] + [(None, 1), ("x", None), ("y", 7)], "url string, label int")
    assert urls.train(df).score(*urls.split("https://cheap-pills.example.org/buy")) > 0.5


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/1", "own", 5)], "page_id long, url string, host string, score int")
    row = urls.judge(df, carry=["host", "score"]).collect()[0]
    assert (row["host"], row["score"], row["host_"], row["verdict"]) == ("own", 5, "a.com", "block") and urls.judge(df, suffix="_u").columns[1] == "host_u"
