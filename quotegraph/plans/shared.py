"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage: if an executor is lost, later stages read it again instead of
recomputing what stands before it. The folder is the one that the cluster names in
``spark.checkpoint.dir``; only a local session, as in tests, may fall back to a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The run's folder below ``spark.checkpoint.dir``, as a URI without a final slash."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault(context.applicationId, tempfile.mkdtemp(prefix="quotegraph-"))
    return f"{base.rstrip('/')}/quotegraph-{context.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing uses yet; it goes when the JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    fs, where = _fs(spark, path)
    fs.deleteOnExit(where)
    return path


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by :func:`fresh_path` that no pending plan reads any more."""
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back; the lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table behind a result of :func:`materialize`."""
    if path := getattr(df, "_written_at", None):
        discard(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly where its scan makes fewer tasks than there are cores, as a small file of one row group does.

    For what follows to be heavy work on each row. A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
