"""How fast queries are, and how far counts have moved from what was recorded (AGG14, AGG15)."""

from __future__ import annotations

import statistics
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.postings import Index
from . import search as plan

# The queries that are timed, and the share a count may move.
TIMED = ("crlf fixture", "playwright chromium headless", "redaction leak checker", "sqlite fts5 index", "nul byte scan", "verify sabotage", "dark mode prefers-color-scheme", "ranking bm25")
DRIFT = 0.40


def latencies(turns: DataFrame, sessions: DataFrame, now: float, queries: Sequence[str] = TIMED, index: Index | None = None) -> dict[str, float]:
    """AGG14: median and maximum in milliseconds from terms to ranked turns, undisplayed."""
    took = []
    for text in queries:
        began = time.perf_counter()
        q = plan.Query(text, now)
        (plan.best_hits(index, sessions, q)[0] if index else plan.turn_hits(turns, sessions, q)).collect()
        took.append(1000 * (time.perf_counter() - began))
    return {"query_ms_median": round(statistics.median(took), 1), "query_ms_max": round(max(took), 1)}


def drifted(measured: DataFrame, recorded: DataFrame, band: float = DRIFT) -> DataFrame:
    """AGG15: (name, n) against (name, n): what is missing or has moved by more than
    ``band`` of what was recorded."""
    both = measured.select("name", F.col("n").alias("now")).join(recorded.select("name", F.col("n").alias("was")), "name", "full")
    moved = F.abs(F.col("now") - F.col("was")) / F.greatest(F.col("was"), F.lit(1)) > band
    return both.filter(F.col("now").isNull() | F.col("was").isNull() | (F.col("was") <= 0) | moved)
