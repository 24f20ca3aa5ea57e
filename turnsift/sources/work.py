"""Written intermediate tables: computed once, lineage cut, in a folder that all executors
share (spark.checkpoint.dir; in a local session without one, a temporary folder)."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_written: list[str] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new path; ``clear`` removes what was written there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="turnsift-work-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = f"file://{_local[0]}"
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def put(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df, written and read again."""
    path = path or folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spool(spark: SparkSession, stream, tag: str, chunk: int = 1 << 20) -> str:
    """A binary stream, copied piece by piece to a new file; its path."""
    path = folder(spark, tag)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    while piece := stream.read(chunk):
        out.write(bytearray(piece))
    out.close()
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Removes, at its end, what was put inside."""
    held = len(_written)
    try:
        yield
    finally:
        while len(_written) > held:
            remove(spark, _written.pop())


def clear(spark: SparkSession) -> None:
    """Removes all that this process has put.  Frames made of it can't be read any more."""
    while _written:
        remove(spark, _written.pop())
