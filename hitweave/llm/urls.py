"""URL filters: host and path rules, and a logistic regression for what no rule decides.

The features are hashed character n-grams of host and path, told apart by a
prefix, with the ends of both marked.  The model is fitted on a small table of
labelled URLs; the table here is invented and serves where none is given.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import extended, free

#: Buckets of the hashed n-grams, and their lengths.
BUCKETS = 1 << 16
LENGTHS = (3, 4, 5)
#: Labelled URLs that a model is fitted on, at most.
ROWS = 100_000

_BLOCKED = (
    "https://cheap-pills.example.com/en/12 http://www.cheap-pills.example.net/de/4.html https://cheap-meds.example.org/buy/now https://pills-online.example.com/order "
    "http://spam-farm.example.org/en/7 https://spam-farm.example.com/fr/81?page=2 https://link-farm.example.net/out/9 https://spam-links.example.org/a/b "
    "https://casino-bonus.example.com/play http://best-casino.example.net/slots/free https://poker-win.example.org/bonus https://bet-fast.example.com/odds "
    "https://adult-cams.example.com/live http://xxx-videos.example.net/watch/1 https://hot-singles.example.org/chat https://porn-tube.example.com/v/3 "
    "https://free-crack.example.com/keygen http://warez-download.example.net/serial https://torrent-movies.example.org/dl/5 https://malware-site.example.com/setup.exe "
    "https://payday-loans.example.com/apply http://quick-cash.example.net/loan https://get-rich.example.org/crypto/double https://fake-rolex.example.com/shop "
    "https://clickbait-news.example.net/you-wont-believe http://win-prize.example.com/claim https://free-gift.example.org/survey https://viagra-shop.example.com/cart "
    "https://ads-server.example.com/click http://track-ads.example.net/pixel https://bets-free.example.org/en/3 http://adult-chat.example.net/de/9"
).split()
_ALLOWED = (
    "https://www.example.com/en/825 http://blog.example.net/de/19.html https://m.example.org/fr/25?page=2 https://news.example.com/2020/05/article "
    "https://docs.example.org/guide/install http://library.example.net/books/history https://www.university.example.org/research/paper https://wiki.example.com/page/Water "
    "https://blog.garden.example.com/es/978 http://www.village.example.net/fr/414 https://m.school.example.org/en/770 https://recipes.example.com/soup/lentil "
    "https://city.example.org/council/minutes http://museum.example.net/exhibits/3 https://weather.example.com/en/today https://www.theatre.example.org/de/252 "
    "https://forum.example.net/thread/99 http://code.example.com/project/readme https://www.hospital.example.org/en/advice https://blog.travel.example.com/es/533/ "
    "https://science.example.net/articles/stars http://www.letters.example.org/fr/65.html https://m.music.example.com/en/474.html https://standards.example.net/rfc/12 "
    "https://thing.example.com/en/148.html http://shed.example.net/en/453 https://www.there.example.org/en/334/ https://blog.rain.example.com/de/612"
).split()
#: The small table of labelled URLs, label 1 to block.
LABELLED: tuple[tuple[str, int], ...] = tuple((u, 1) for u in _BLOCKED) + tuple((u, 0) for u in _ALLOWED)

#: Rules (verdict, host, path): of those that fit, the longest in characters wins.
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that decides, written as host and path, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def split(url: str | None) -> tuple[str, str]:
    """``host_and_path`` for one URL."""
    import re

    _, found, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if found else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if found else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def features(host: str, path: str):
    """Buckets of the character n-grams of ``^host$`` and ``^path$``, each once."""
    import zlib

    out = set()
    for kind, text in ((b"h", f"^{host}$".encode()), (b"p", f"^{path}$".encode())):
        for n in LENGTHS:
            for at in range(len(text) - n + 1):
                out.add(zlib.crc32(kind + text[at : at + n]) % BUCKETS)
    return sorted(out)


@dataclasses.dataclass
class Model:
    weights: object
    bias: float

    def score(self, host: str, path: str) -> float:
        import math

        found = features(host, path)
        z = self.bias + (float(self.weights[found].sum()) / math.sqrt(len(found)) if found else 0.0)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def fit(rows: Iterable[tuple[str | None, int]], steps: int = 300, penalty: float = 1e-3) -> Model:
    """Logistic regression of label 1 on the n-grams, by gradient steps from zero; without rows every score is a half."""
    import numpy as np

    index, owner, scale, y = [], [], [], []
    for url, label in rows:
        found = features(*split(url))
        index += found
        owner += [len(y)] * len(found)
        scale += [1 / max(1, len(found)) ** 0.5] * len(found)
        y.append(float(label))
    weights, bias = np.zeros(BUCKETS), 0.0
    if not y:
        return Model(weights, bias)
    index, owner, scale, y = np.array(index, np.int64), np.array(owner, np.int64), np.array(scale), np.array(y)
    for _ in range(steps):
        z = np.bincount(owner, weights[index] * scale, len(y)) + bias
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        weights -= 20 * (np.bincount(index, error[owner] * scale, BUCKETS) + penalty / len(y) * weights)
        bias -= 5 * error.sum()
    return Model(weights, bias)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rows: int = ROWS) -> Model:
    """A model fitted on at most ``rows`` rows of a labelled table, those with the smallest hashed URLs.  Labels other than 0 and 1 are left out."""
    some = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    picked = some.orderBy(F.xxhash64("url"), "url", "label").limit(rows).collect()
    return fit((r.url, r.label) for r in picked)


def _scored(batches, model):
    import pyarrow as pa

    model = model.value
    for batch in batches:
        hosts, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        scores = [model.score(h, p) for h, p in zip(hosts, paths, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def judge(
    pages: DataFrame,
    model: Model | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    url_col: str = "url",
    threshold: float = 0.5,
    carry: Iterable[str] = ("page_id",),
    suffix: str = "",
) -> DataFrame:
    """``(*carry, host, path, rule, score, verdict)`` for every row of ``pages``; nothing is shuffled.

    A rule fits its host and all subdomains where the path starts as the rule's;
    the longest decides, and where none fits the model blocks at ``threshold``
    or more.  A null URL, or one without ``://``, has an empty host and path.
    Rows repeated in ``pages`` each give a row.  ``suffix`` ends the names of the
    five columns, which give way to carried ones of their names by underscores.
    """
    carry = list(carry)
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(host.alias("host"), path.alias("path"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(LABELLED))
    got = rows.mapInArrow(lambda b: _scored(b, sent), extended(rows, 0, "score double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = {
        "host": F.col("host"), "path": F.col("path"), "rule": rule, "score": F.col("score"),
        "verdict": F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")),
    }
    return got.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], *[c.alias(n) for c, n in zip(own.values(), free(own, carry, suffix), strict=True)])
