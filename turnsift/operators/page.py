"""Search and display as the demo page has them: substrings instead of tokens, ages in
whole days (TXT16, TXT17, SRT6)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.score import haystack, kind_points, phrase_points, terms_points
from ..schema import EXCERPT_WIDTH, RECENCY_BANDS, TERM_POINTS

PAGE_LIMIT, LEAD = 8, 60
DOTS = "…"


def age_days(ts: Column, now: float) -> Column:
    """Whole days; null for an undated turn."""
    return F.when(ts > 0, F.floor((F.lit(float(now)) - ts) / 86400.0))


def page_search(turns: DataFrame, terms: Sequence[str], now: float, kind: str | None = None, limit: int = PAGE_LIMIT) -> DataFrame:
    """All turns that hold every term as a substring; meta only where it is asked for."""
    found = turns.filter(F.col("kind") == kind if kind else F.col("kind") != "meta")
    hay = haystack(F.col("text"), F.col("target"))
    points = terms_points(hay, terms)
    distinct = len(dict.fromkeys(terms))
    found = found.filter(points == TERM_POINTS * distinct).withColumn("age", age_days(F.col("ts"), now))
    recency = F.lit(0)
    for days, bonus in reversed(RECENCY_BANDS):
        recency = F.when(F.col("age") <= days, bonus).otherwise(recency)
    parts = {"kind_pts": kind_points(F.col("kind")), "terms_pts": points, "phrase_pts": phrase_points(hay, terms, points), "recency_pts": recency}
    scored = found.withColumns(parts).withColumn("score", (F.col("kind_pts") + F.col("terms_pts") + F.col("phrase_pts") + F.col("recency_pts")).cast("int"))
    return scored.orderBy(F.desc("score"), F.coalesce("age", F.lit(0)), "session_id", "seq").limit(limit)


def page_snip(text: Column, terms: Sequence[str], width: int = EXCERPT_WIDTH) -> Column:
    """``width`` characters from LEAD before the first term that occurs, as one line."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    at = F.coalesce(*[F.nullif(F.instr(F.lower(flat), t.lower()), F.lit(0)) for t in terms], F.lit(0)) if terms else F.lit(0)
    begin = F.greatest(at - 1 - LEAD, F.lit(0))
    cut = F.concat(F.when(begin > 0, DOTS).otherwise(""), F.substring(flat, begin + 1, F.lit(width)), F.when(begin + width < F.length(flat), DOTS).otherwise(""))
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """HTML with each term, in any case, in a mark."""
    html = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for term in filter(None, terms):
        html = F.regexp_replace(html, f"(?iu){re.escape(term)}", "<mark>$0</mark>")
    return html


def page_when(age: Column) -> Column:
    months, years = F.round(age / 30).cast("int"), F.format_string("%.1f years ago", age / 365)
    long = F.when(age < 60, F.concat(age.cast("string"), F.lit(" days ago"))).when(age < 730, F.concat(months.cast("string"), F.lit(" months ago"))).otherwise(years)
    return F.when(age.isNull(), "undated").when(age <= 0, "today").when(age == 1, "yesterday").otherwise(long)
