"""A query to shown rows.  Excerpts and redaction come after the limit, so their Arrow
passes see the rows that are shown and no others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import excerpt
from ..functions.redact import redact_fields, redact_text
from ..functions.text import split_query
from ..operators import context, postings, search
from ..operators.filters import Filters
from ..schema import DEFAULT_LIMIT


@dataclass
class Query:
    text: str
    now: float
    filters: Filters = field(default_factory=Filters)
    limit: int = DEFAULT_LIMIT
    scan: int | None = None
    redact_first: bool = False  # redact whole texts, then excerpt; by default the reverse
    account: str | None = None

    @property
    def terms(self) -> list[str]:
        return split_query(self.text)


def scored(turns: DataFrame, sessions: DataFrame, q: Query, index: postings.Index | None = None) -> DataFrame:
    """All hits with their scores; by a scan of the turns where there is no term index."""
    if index and q.terms:
        found = postings.candidates(index, sessions, q.terms, q.filters, q.scan)
    else:
        found = search.candidates(search.with_sessions(turns, sessions), q.terms, q.filters, q.scan)
    return search.score(found, q.terms, q.now)


def top_of(found: DataFrame, q: Query) -> DataFrame:
    return search.top_turns(found, q.limit)


def sessions_of(found: DataFrame, q: Query) -> DataFrame:
    return search.with_texts(search.top_sessions(search.rank_sessions(found), q.limit), found, q.limit)


def turn_hits(turns: DataFrame, sessions: DataFrame, q: Query) -> DataFrame:
    return top_of(scored(turns, sessions, q), q)


def best_hits(index: postings.Index, sessions: DataFrame, q: Query) -> tuple[DataFrame, postings.Reads]:
    """turn_hits without a look at turns that cannot place; no scan cap."""
    return postings.top(index, sessions, q.terms, q.now, q.limit, q.filters)


def session_hits(turns: DataFrame, sessions: DataFrame, q: Query) -> DataFrame:
    return sessions_of(scored(turns, sessions, q), q)


def shown(hits: DataFrame, q: Query) -> DataFrame:
    """Hits with safe texts: excerpt, and project, target, path, title and tool masked."""
    whole = redact_text(F.col("text"), q.account) if q.redact_first else F.col("text")
    cut = hits.withColumn("excerpt", excerpt.snip_column(whole, q.terms))
    cut = cut.withColumn("target_line", excerpt.context_line(F.col("target"), 100))
    names = [c for c in ("excerpt", "target", "target_line", "project", "path", "title", "tool") if c in cut.columns]
    safe = redact_fields(cut, {c: F.col(c) for c in names}, q.account)
    return safe.withColumn("when", excerpt.when(F.col("ts"))).withColumn("ago", excerpt.ago(F.col("ts"), q.now))


def around(hits: DataFrame, turns: DataFrame, q: Query, span: int = 1) -> DataFrame:
    """One join for the context of all hits."""
    near = context.neighbours(hits, turns, span, span, most_hits=q.limit)
    return redact_fields(near, {"line": excerpt.context_line(F.col("text"))}, q.account).select("hit_id", "seq", "offset", "kind", "line")


def audit_ready(turns: DataFrame, account: str | None = None, fields: Sequence[str] = ("text", "target")) -> DataFrame:
    """AGG16: each turn's redacted text and target on lines of their own, for an auditor."""
    safe = redact_fields(turns.select("turn_id", *fields), {f: F.col(f) for f in fields}, account)
    return safe.select("turn_id", F.concat_ws("\n", *fields).alias("text"))
