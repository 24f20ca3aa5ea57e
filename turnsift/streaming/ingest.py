"""Structured Streaming over a folder of transcripts (an extension beyond full rebuilds).

New files are read by splits, parsed line by line as they appear, and appended as
emissions with their place (split and position in it), so no task holds a file.  Line
numbers, turns and sessions are worked out from all emissions by ``tables``, as a full
rebuild does, so a stream and a rebuild give the same tables.  A file must be complete when
it appears: it is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.archive import split_lines
from ..sources.parse import build, emissions, numbered


def stream_lines(spark: SparkSession, root: str, source: str) -> DataFrame:
    """source, path, start and raw of each line of each new file, blank ones included."""
    return split_lines(spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root), source)


def start(spark: SparkSession, root: str, source: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends emissions to a Parquet folder; the checkpoint remembers the files seen."""
    writer = emissions(stream_lines(spark, root, source)).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tables(spark: SparkSession, table: str, home: str = "/nonexistent") -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns, sessions and counters of all emissions so far.  ``work.clear`` removes what
    is written on the way."""
    return build(numbered(spark.read.parquet(table)), home=home)
