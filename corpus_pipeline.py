"""A training corpus from ``documents``, in five stages; each works on what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of ``docs``; the last adds those of the mixture.  Further columns, whatever
their names, are carried along.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.llm import decontaminate, mixing, pii, similar, toxicity
from hitweave.llm._base import written
from hitweave.llm.queries import PII_KEY


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a score of a half or more, by a model of the labels outside of the held-out fold.

    Null, empty and wordless texts score 0 and stay; repeated rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    return toxicity.scored(docs, model, carry=docs.columns, suffix="_toxicity").where("score_toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (0.8 of the five-word shingles or more) keeps the document of the smallest id.

    Null, empty and wordless texts are copies of each other; of rows that repeat the
    smallest id one stays, and rows without an id stay only where their class has no other.
    """
    return similar.without_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that share ten words in a row with a benchmark item, or all words of a shorter one.

    Null, empty and wordless texts stay; repeated rows stay or go together.
    """
    got = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=docs.columns, suffix="_benchmark")
    return got.where("n_hit_benchmark = 0").select(*docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values by pseudonyms of the same format.

    Null and empty texts stay as they are; ``n_chars`` follows the new text.
    """
    rest = [c for c in docs.columns if c != "text"]
    got = pii.pseudonyms(docs, PII_KEY, carry=rest, suffix="_pii")
    new = {"text": F.col("text_pii"), "n_chars": F.char_length("text_pii").cast("long")}
    return got.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats the documents so that a source weighs as the square root of its size, and shuffles them.

    Rows of equal ids, null ones too, are drawn alike; a null source is one of its own.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("mixing", mix_sources),
]

#: SQL can't express the fitted model of the first stage; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole of ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
