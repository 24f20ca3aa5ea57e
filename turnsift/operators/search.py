"""Scoring, top-k turns and ranked sessions (TXT9, TXT10, SRT1-SRT3, AGG9, WIN6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import parts
from ..functions.text import matches
from ..schema import MOST_EXTRA
from .filters import Filters


def best_first() -> list:
    """SRT1, with turn_id as the last key, so that ties have one order."""
    return [F.desc("score"), F.desc("ts"), F.asc("session_id"), F.asc("seq"), F.asc("turn_id")]


def with_sessions(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """JON1.  AQE broadcasts sessions where they are small; nothing is forced."""
    return turns.drop("source").join(sessions.drop("turns"), "session_key")


def candidates(joined: DataFrame, terms: Sequence[str], filters: Filters = Filters(), scan: int | None = None, folded: bool = True) -> DataFrame:
    """FLT1-FLT11.  scan: keep so many, by turn_id; by default all are ranked."""
    out = joined.filter(filters.predicate())
    if terms:
        out = out.filter(matches(terms, folded=folded))
    return out.orderBy("turn_id").limit(scan) if scan else out


def score(found: DataFrame, terms: Sequence[str], now: float) -> DataFrame:
    """Adds kind_pts, terms_pts, phrase_pts, recency_pts and score."""
    own = parts(terms, now)
    return found.withColumns(own).withColumn("score", (F.col("kind_pts") + F.col("terms_pts") + F.col("phrase_pts") + F.col("recency_pts")).cast("int"))


def top_turns(scored: DataFrame, limit: int) -> DataFrame:
    """One TakeOrderedAndProject: no full sort, no shuffle of what does not place."""
    return scored.orderBy(*best_first()).limit(limit)


_TEXTS = ("text", "target", "text_tok", "target_tok")


def rank_sessions(scored: DataFrame) -> DataFrame:
    """The best turn of each (source, session_id), its hits, extra for repeats, score.

    A maximum over a struct of short columns: partial aggregation before the shuffle, so
    that a session with very many hits is one row for each task.  Texts stay behind;
    ``with_texts`` fetches those of the few rows that are shown.
    """
    rest = [c for c in scored.columns if c not in ("source", "session_id", "score", "ts", "seq", "turn_id", *_TEXTS)]
    key = F.struct("score", "ts", (-F.col("seq")).alias("nseq"), (-F.col("turn_id")).alias("nid"), F.struct(*rest).alias("row"))
    best = scored.groupBy("source", "session_id").agg(F.max(key).alias("b"), F.count(F.lit(1)).alias("hits"))
    extra = F.least(F.lit(MOST_EXTRA), F.col("hits") - 1).cast("int")
    return best.select("source", "session_id", F.col("b.score").alias("best"), extra.alias("extra"), (F.col("b.score") + extra).alias("score"), "hits", F.col("b.ts").alias("ts"), (-F.col("b.nseq")).alias("seq"), (-F.col("b.nid")).alias("turn_id"), "b.row.*")


def top_sessions(ranked: DataFrame, limit: int) -> DataFrame:
    """SRT2."""
    return ranked.orderBy(F.desc("score"), F.desc("last_ts"), F.asc("session_id"), F.asc("source")).limit(limit)


def with_texts(top: DataFrame, turns: DataFrame, limit: int) -> DataFrame:
    """text and target of at most ``limit`` ranked rows, in their order."""
    return top_sessions(turns.select("turn_id", "text", "target").join(F.broadcast(top), "turn_id"), limit)


def rank_position(scored: DataFrame) -> DataFrame:
    """WIN7, on what is shown: a global order is one task's work."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*best_first())))
