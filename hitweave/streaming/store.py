"""A collection on disk that grows by batches.

``records/batch=N``, ``extents/batch=N``, ``postings/batch=N`` hold what batch ``N``
brought, ``deleted/batch=N`` the keys that it deletes or restores.  A batch is
written as a whole and again in the same place if it is repeated, so a stream that
restarts writes nothing twice.  Of a key, the newest batch counts; a search is over
what is live now.  ``compact`` writes the live part as one batch of a new store.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import _POSTINGS, EXTENT, RECORD, Collection, _opened, _packed, by_field
from ..functions.text import ASCII_WORD
from .upserts import newest

_RECORDS = "rec_id long, " + ", ".join(f"{k} {t}" for k, t in RECORD.items()) + ", text string, rec_len long, batch long"
_EXTENTS = ", ".join(f"{k} {t}" for k, t in EXTENT.items()) + ", batch long"


@dataclasses.dataclass
class Store:
    """A growing collection at ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str
    pattern: str = ASCII_WORD
    stopwords: frozenset[str] = frozenset()

    def _write(self, name: str, batch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def append(self, batch: int, recs: DataFrame, exts: DataFrame | None = None) -> None:
        """Adds a batch; records that repeat a key replace those of batches before, and of one batch the last by ``rec_start``, then id."""
        recs = newest(recs, "key", "rec_start", "rec_id")
        gone = recs.where("deleted and text = ''").select("key", F.lit(True).alias("deleted"))
        self._write("records", batch, recs.where("not (deleted and text = '')"))
        self._write("deleted", batch, gone)
        kept = self.spark.read.schema(_RECORDS.rsplit(", ", 1)[0]).parquet(f"{self.path}/records/batch={batch}")
        self._write("postings", batch, _packed(kept, self.pattern, self.stopwords))
        if exts is not None:
            self._write("extents", batch, by_field(exts.select(*EXTENT).join(kept.select("rec_id"), "rec_id", "left_semi")))

    def delete(self, batch: int, keys: DataFrame, restore: bool = False) -> None:
        """Deletes the records of the keys, or restores them."""
        self._write("deleted", batch, keys.select(F.col("key").cast("string").alias("key"), F.lit(not restore).alias("deleted")).distinct())

    def live(self, now=None) -> DataFrame:
        """The records that count, with their batch: the newest of each key, neither deleted since nor expired."""
        rows = newest(self._read("records", _RECORDS), "key", "batch", "rec_start", "rec_id")
        marks = newest(self._read("deleted", "key string, deleted boolean, batch long"), "key", "batch")
        rows = rows.join(marks.select("key", F.col("deleted").alias("_gone"), F.col("batch").alias("_at")), "key", "left")
        rows = rows.where(~F.coalesce(F.col("_gone") & (F.col("_at") >= F.col("batch")), F.lit(False)) & ~F.coalesce("deleted", F.lit(False)))
        if now is not None:
            rows = rows.where(F.coalesce(F.col("date_expires") > now, F.lit(True)))
        return rows.select(*[x.split()[0] for x in _RECORDS.split(", ")])

    def collection(self, now=None) -> Collection:
        """What is live as a collection; its postings and extents are those of live records' own batches."""
        rows = self.live(now)
        alive = rows.select("rec_id", "batch")
        posts = _opened(self._read("postings", _POSTINGS + ", batch long")).join(alive, ["rec_id", "batch"], "left_semi").drop("batch")
        exts = self._read("extents", _EXTENTS).join(alive, ["rec_id", "batch"], "left_semi").drop("batch")
        return Collection(self.spark, rows.drop("batch"), posts, exts, self.pattern, self.stopwords)

    def compact(self, path: str, now=None) -> Store:
        """A store at ``path`` with what is live, as its batch 0; versions, deletions and expired records are gone."""
        new = Store(self.spark, path, self.pattern, self.stopwords)
        c = self.collection(now)
        new.append(0, c.records, c.extents)
        return new
