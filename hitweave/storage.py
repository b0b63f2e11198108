"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what the session names in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder, on a single machine only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    root = tempfile.mkdtemp(prefix="hitweave-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, which is deleted at the end of the driver process."""
    path = f"{scratch(spark)}/hitweave-{tag}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_discard_all)
    _tables.append((spark, path))
    return path


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a table in the shared folder, which survives lost executors.

    The table stays until ``discard`` or the end of the driver process.
    """
    spark = df.sparkSession
    path = folder(spark, tag)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hitweave_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """A small input of fewer parts than there are cores, dealt out to all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame) -> int:
    """The bytes of the files of a table made by ``written``."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._hitweave_path)
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``written`` that nothing reads any more."""
    _delete(df.sparkSession, df._hitweave_path)
    _tables[:] = [t for t in _tables if t[1] != df._hitweave_path]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _discard_all() -> None:
    for spark, path in _tables:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; its folder is the cluster's to clean
            return
