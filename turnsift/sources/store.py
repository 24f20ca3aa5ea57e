"""The index as versioned Parquet tables (SNK1-SNK8).

A build writes a new version folder and then switches the pointer, a one-row table, so
a reader never sees half an index.  Turns lie partitioned by the source of their session,
which is what context and statistics read; searches read the term index beside them.
"""

from __future__ import annotations

import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings
from ..schema import SCHEMA_VERSION
from .archive import _exists


class StoreError(Exception):
    """code: the exit code of the command line."""

    def __init__(self, message: str, code: int):
        super().__init__(message)
        self.code = code


def default_path() -> str:
    """SNK6."""
    if named := os.environ.get("TURNSIFT_INDEX"):
        return named
    base = os.environ.get("XDG_DATA_HOME") or os.path.join(os.path.expanduser("~"), ".local", "share")
    return os.path.join(base, "turnsift", "index")


def guard(path: str) -> None:
    """SNK7: transcripts never go below this repository."""
    if "://" not in path and Path(__file__).resolve().parents[2] in [p := Path(path).resolve(), *p.parents]:
        raise StoreError("the index must lie outside the repository", 4)


def write(path: str, turns: DataFrame, sessions: DataFrame, meta: dict) -> str:
    """SNK2-SNK5: a full rebuild."""
    guard(path)
    spark = turns.sparkSession
    version = f"v{time.time_ns()}"
    base = f"{path.rstrip('/')}/{version}"
    keyed = turns.join(sessions.select("session_key", "source"), "session_key")
    keyed.repartition("source", "session_key").sortWithinPartitions("source", "session_key", "seq").write.partitionBy("source").parquet(f"{base}/turns")
    sessions.write.parquet(f"{base}/sessions")
    postings.write(spark.read.parquet(f"{base}/turns").withColumn("source", F.col("source").cast("string")), f"{base}/terms")
    rows = [(str(k), str(v)) for k, v in {**meta, "schema_version": SCHEMA_VERSION}.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.parquet(f"{base}/meta")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/current")
    return version


def _current(spark: SparkSession, path: str) -> str:
    root = path.rstrip("/")
    if not _exists(spark, f"{root}/current"):
        raise StoreError(f"no index at {path}; build one with: turnsift index", 5)
    return f"{root}/{spark.read.parquet(f'{root}/current').first()['version']}"


def read_terms(spark: SparkSession, path: str) -> postings.Index:
    """The term index of the current version."""
    return postings.read(spark, f"{_current(spark, path)}/terms")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """SNK8: turns (with source), sessions and meta of the current version."""
    base = _current(spark, path)
    meta = {r["key"]: r["value"] for r in spark.read.parquet(f"{base}/meta").collect()}
    if meta.get("schema_version") != str(SCHEMA_VERSION):
        raise StoreError("the index was written with another schema version; rebuild it", 5)
    return spark.read.parquet(f"{base}/turns").withColumn("source", F.col("source").cast("string")), spark.read.parquet(f"{base}/sessions"), meta


def size_bytes(spark: SparkSession, path: str) -> int:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hadoop).getLength()
