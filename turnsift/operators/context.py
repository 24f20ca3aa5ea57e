"""Neighbours of hits and windows of one session (JON5, JON6, WIN5, SRT4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BROADCAST = 10_000


def neighbours(hits: DataFrame, turns: DataFrame, before: int = 1, after: int = 1, most_hits: int | None = None) -> DataFrame:
    """The turns of a hit's session whose seq lies in its window, the hit among them.

    The range becomes an equi-join: each hit names the seq values it wants, so neither
    side is compared beyond its key.  most_hits: a proven bound on the rows of hits;
    within MOST_BROADCAST they are broadcast and turns are not shuffled.
    """
    wanted = hits.select("session_key", F.col("seq").alias("hit_seq"), F.col("turn_id").alias("hit_id"), F.explode(F.sequence(F.col("seq") - before, F.col("seq") + after)).alias("seq"))
    if most_hits is not None and most_hits <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    return turns.join(wanted, ["session_key", "seq"]).withColumn("offset", (F.col("seq") - F.col("hit_seq")).cast("int"))


def with_context(turns: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """The bulk form: each turn with its neighbours' texts, by seq value, not by row."""
    w = Window.partitionBy("session_key").orderBy("seq").rangeBetween(-before, after)
    return turns.withColumn("around", F.collect_list(F.struct("seq", "kind", "text")).over(w))


def find_session(sessions: DataFrame, prefix: str) -> DataFrame:
    """The latest session whose id starts so; ties by id, source, path."""
    like = prefix.replace("\\", "\\\\")
    return sessions.filter(F.col("session_id").ilike(f"{like}%")).orderBy(F.desc("last_ts"), "session_id", "source", "path").limit(1)


def show_window(turns: DataFrame, sessions: DataFrame, prefix: str, seq: int = 0, span: int = 5) -> DataFrame:
    """JON6: turns around seq of that session; the lower end stops at 0."""
    one = F.broadcast(find_session(sessions, prefix).select("session_key"))
    return turns.filter(F.col("seq").between(max(0, seq - span), seq + span)).join(one, "session_key").orderBy("seq")
