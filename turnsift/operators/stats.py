"""What is in an index (AGG1-AGG6, FLT13, FLT14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """AGG1, AGG2, AGG6: one row."""
    dated = F.col("first_ts") > 0
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("project").alias("projects"), F.coalesce(F.min(F.when(dated, F.col("first_ts"))), F.lit(0.0)).alias("first_ts"), F.coalesce(F.max(F.when(dated, F.col("last_ts"))), F.lit(0.0)).alias("last_ts"))
    return s.crossJoin(turns.agg(F.count(F.lit(1)).alias("turns")))  # one row by one row


def by_kind(turns: DataFrame) -> DataFrame:
    return turns.groupBy("kind").count().orderBy(F.desc("count"), "kind")


def by_source(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("source").count().orderBy(F.desc("count"), "source")


def top_tools(turns: DataFrame, limit: int = 20) -> DataFrame:
    return turns.filter("tool <> ''").groupBy("tool").count().orderBy(F.desc("count"), "tool").limit(limit)
