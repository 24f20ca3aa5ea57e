"""Running values over the lines of a file, in two passes: within chunks of lines, and
over one row a chunk.  No task holds a file, whatever its size, nor all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 50_000
ORDER = ("line_no", "pos")


def _cut(df: DataFrame, lines: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col("line_no") / lines))


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def running_number(df: DataFrame, keys: Sequence[str], name: str = "seq", lines: int = LINES) -> DataFrame:
    """WIN1, WIN2: the number, from 0, of each row among those of its keys (none null), by
    line and place."""
    cut = _cut(df, lines)
    counts = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*ORDER)) - 1
    both = cut.withColumn("_in", inside).join(starts, [*keys, "_chunk"])
    return both.withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_chunk", "_before", "_in")


def latest(df: DataFrame, keys: Sequence[str], value: Column, name: str, lines: int = LINES) -> DataFrame:
    """JON3, WIN4: the last value that isn't null up to each row of its keys (none null), by
    line and place; null before the first."""
    cut = _cut(df.withColumn("_v", value), lines)
    there = F.col("_v").isNotNull()
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by("_v", F.when(there, F.struct(*ORDER))).alias("_last"))
    carried = ends.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(_earlier(keys)).alias("_carried"))
    so_far = Window.partitionBy(*keys, "_chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    both = cut.withColumn("_own", F.last("_v", ignorenulls=True).over(so_far)).join(carried, [*keys, "_chunk"])
    return both.withColumn(name, F.coalesce("_own", "_carried")).drop("_chunk", "_v", "_own", "_carried")


#: Splits of files of which offsets are broadcast, at about a hundred bytes each.
MOST_SPLITS = 500_000


def number_lines(df: DataFrame, splits: DataFrame) -> DataFrame:
    """SRC5: line_no from split offsets.  df: path, start (of the split in its file) and at
    (ascending by one a line within a split); splits: as ``line_splits`` gave it, written."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = splits.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_by"))
    if splits.count() <= MOST_SPLITS:
        moved = F.broadcast(moved)
    return df.join(moved, ["path", "start"]).withColumn("line_no", (F.col("at") + F.col("_by")).cast("int")).drop("_by")


def line_splits(df: DataFrame) -> DataFrame:
    """One row a split: its first ``at`` and its number of lines, blank ones included."""
    return df.groupBy("path", "start").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("n"))
