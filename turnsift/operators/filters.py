"""The conjunctive filters of a search (FLT1-FLT14) as one predicate, and the date grammar."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of the units of a relative date.
UNITS = {"d": 86_400, "w": 604_800, "mo": 2_592_000, "y": 31_536_000}


@dataclass(frozen=True)
class Filters:
    kind: Sequence[str] = ()
    tool: Sequence[str] = ()
    project: str | None = None
    source: Sequence[str] = ()
    session: str | None = None
    since: float | None = None
    until: float | None = None
    include_meta: bool = False
    sidechain: bool | None = None

    def predicate(self) -> Column:
        """Parquet takes kind, ts and source from it; text conditions stay above the scan."""
        out = F.lit(True)
        if self.kind:
            out &= F.col("kind").isin(list(self.kind))
        elif not self.include_meta:
            out &= F.col("kind") != "meta"
        if self.tool:
            out &= F.lower("tool").isin([t.lower() for t in self.tool])
        if self.project:
            out &= F.col("project").ilike(f"%{_literal(self.project)}%")
        if self.source:
            out &= F.col("source").isin(list(self.source))
        if self.session:
            out &= F.col("session_id").ilike(f"{_literal(self.session)}%")
        if self.since is not None:
            out &= F.col("ts") >= self.since
        if self.until is not None:
            out &= F.col("ts") <= self.until
        if self.sidechain is not None:
            out &= F.col("sidechain") == self.sidechain
        return out


def _literal(pattern: str) -> str:
    """% and _ stay wildcards; a backslash is a character."""
    return pattern.replace("\\", "\\\\")


def parse_when(text: str | None, now: float, zone: tzinfo | None = None) -> float | None:
    """FLT12: today, 7d / 2w / 6mo / 1y back from now, or an ISO date; else ValueError."""
    if not text:
        return None
    if text == "today":
        return datetime.fromtimestamp(now, zone).replace(hour=0, minute=0, second=0, microsecond=0).timestamp()
    if m := re.fullmatch(r"(\d+)(mo|[dwy])", text):
        return now - int(m[1]) * UNITS[m[2]]
    at = datetime.fromisoformat(text)
    return (at if at.tzinfo or zone is None else at.replace(tzinfo=zone)).timestamp()
