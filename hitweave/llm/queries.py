"""The thin queries that bind the operators to the tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extract, licenses, mixing, pii, simhash, substrings, topk, toxicity, urls


#: The key of the pseudonyms where none is given; a deployment passes its own.
PII_KEY = b"hitweave: an example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page.  Null and empty html and pages without text give an empty text; repeated pages a row each; other columns are left."""
    return extract.extract(_table(spark, sf_dir, "pages"))


def _held_out() -> Column:
    """The fold whose labels nothing may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op2_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document by a model of the labels outside of the held-out fold.  Null, empty and wordless texts score 0; repeated rows give a row each; a null id is not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~_held_out()))
    got = toxicity.scored(docs, model)
    return got.select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"), F.to_json("offending").alias("offending"),
    )


def op3_simhash_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class.  Null, empty and wordless texts have fingerprint zero and are one class; repeated rows give a row each; a class without any id has none."""
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return got.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and labels.  A null text is an empty one, without words; repeated rows give a row each."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op5_suffix_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document repeats earlier strings.  Null and empty texts have no bytes; null ids come last as one document; of rows that repeat an id, equal places aren't earlier."""
    got = substrings.repeated_substrings(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op6_benchmark_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is in the benchmark.  Null, empty and wordless texts and items have no windows; items without an id mark words only; repeated rows give a row each."""
    got = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_url_filter_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url.  A null url, or one without ``://``, has an empty host and path, which the model judges; repeated rows give a row each."""
    return urls.judge(_table(spark, sf_dir, "pages"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as often as drawn, with their copy's number.  Rows of equal ids, null ones too, are drawn alike; a null source is one of its own; without text a source has the rate 1."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def _same(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.when(x == kind, x)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for personal values.  A null text stays null, an empty one empty; repeated rows give a row each."""
    got = pii.pseudonyms(_table(spark, sf_dir, "documents"), PII_KEY)
    names = F.transform("found", lambda x: x["kind"])
    kinds = [F.size(F.array_compact(F.transform(names, _same(kind)))).alias(f"n_{kind}") for kind, _, _ in pii.KINDS]
    return got.select("doc_id", "text", F.size("found").alias("n_found"), *kinds)


def op10_topk_impact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every query vector.  Null, incomplete and non-finite vectors and null ids take no part; ties go to the smaller id; a repeated query is answered once."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text_path_ratios,
        op2_toxicity_noisy_or,
        op3_simhash_anchor_dedup,
        op4_license_templates,
        op5_suffix_substring_dedup,
        op6_benchmark_winnowing,
        op7_url_filter_ngrams,
        op8_poisson_mixing,
        op9_feistel_pseudonyms,
        op10_topk_impact_ordered,
    )
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"



def _license_sql() -> str:
    """The automata as regular expressions over words that are each followed by a space."""
    compiled = [licenses.compile_template(*t) for t in licenses.TEMPLATES]
    tests = [f"regexp_matches(line, '(?:^| ){a.regex()}')" for a in compiled]
    labels = ", ".join(f"CASE WHEN {t} THEN '{a.label}' END" for a, t in zip(compiled, tests, strict=True))
    most = ", ".join(f"CASE WHEN {t} THEN {a.mandatory} ELSE 0 END" for a, t in zip(compiled, tests, strict=True))
    starts = " UNION ALL ".join(
        f"SELECT r, i - 1 AS place, '{label}' AS label FROM docs, unnest(range(1, len(w) + 1)) AS t(i) WHERE "
        + " AND ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
lines AS (SELECT *, array_to_string(w, ' ') || ' ' AS line FROM docs),
starts AS ({starts}),
base AS (
    SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS l FROM starts GROUP BY r
),
found AS (
    SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(l, []) AS l,
        list_filter([{labels}], lambda x: x IS NOT NULL) AS more, greatest({most}) AS most
    FROM lines LEFT JOIN base USING (r)
)
SELECT doc_id, n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    array_to_string(l, ',') AS base_labels, array_to_string(list_sort(list_distinct(l || more)), ',') AS labels,
    CASE WHEN len(l) + len(more) = 0 THEN 0.0 ELSE 0.5 + 0.5 * (1 - pow(0.5, most / 4.0)) END AS score
FROM found
"""


ORACLE_SQL: dict[str, str] = {
    "op4_license_templates": _license_sql(),
    "op8_poisson_mixing": """
WITH own AS (SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS bytes FROM documents GROUP BY source),
rates AS (
    SELECT source, CASE WHEN bytes > 0 THEN pow(bytes, 0.5) / (SELECT sum(pow(bytes, 0.5)) FROM own) * (SELECT sum(bytes) FROM own) / bytes ELSE 1.0 END AS rate
    FROM own
),
means AS (SELECT source, rate, CAST(greatest(ceil(rate / 16.0), 1) AS BIGINT) AS parts, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates),
terms AS (SELECT source, rate, parts, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM means, range(0, 101) AS t(k)),
tables AS (
    SELECT source, rate, parts, list(c ORDER BY k) AS cdf FROM (SELECT *, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source, rate, parts
),
draws AS (
    SELECT d.*, rate, cdf, coalesce(CAST(doc_id AS VARCHAR), '') AS ident, unnest(range(1, parts + 1)) AS part, parts
    FROM (SELECT *, row_number() OVER () AS r FROM documents) AS d JOIN tables AS t ON d.source IS NOT DISTINCT FROM t.source
),
hashed AS (SELECT *, md5(CASE WHEN parts = 1 THEN '0:' || ident ELSE '0/part:' || ident || ':' || part END)[1:13] AS h FROM draws),
drawn AS (
    SELECT doc_id, text, lang, source, n_chars, rate, ident,
        sum(len(list_filter(cdf, lambda c: c < 1.0 AND c <= CAST(CAST('0x' || h AS BIGINT) AS DOUBLE) / pow(2, 52)))) AS n
    FROM hashed GROUP BY r, doc_id, text, lang, source, n_chars, rate, ident
)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS copy, rate, md5('0/copy:' || ident || ':' || k)[1:16] AS shuffle_key
FROM drawn, unnest(range(1, CAST(n AS BIGINT) + 1)) AS t(k)
""",
    "op10_topk_impact_ordered": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v AS q, v AS c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op6_benchmark_winnowing": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
test AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
    FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
),
grams AS (
    SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
    FROM docs, (SELECT DISTINCT n FROM test) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
),
hits AS (SELECT r, i, n, item_id FROM grams JOIN test USING (n, gram)),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY r),
found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
""",
}
