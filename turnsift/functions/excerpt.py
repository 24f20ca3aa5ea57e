"""Excerpts and display scalars (TXT11-TXT15), as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONTEXT_WIDTH, EXCERPT_WIDTH
from .score import bound, positions

DOTS = "…"


_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def _window_start(low: Column, terms: Sequence[str], width: int) -> Column:
    """TXT11: of the windows that start at an occurrence, the one with most distinct terms
    (SET3) wholly inside, then the tightest, then the first.  Null without an occurrence."""
    named = lambda t, k: F.transform(positions(low, t), lambda p: F.struct(p.alias("at"), (p + len(t)).alias("end"), F.lit(k).alias("k")))
    each = [named(t, k) for k, t in enumerate(dict.fromkeys(t.lower() for t in terms))]

    def best(hits: Column) -> Column:
        def rank(at: Column) -> Column:
            inside = F.filter(hits, lambda h: (h["at"] >= at) & (h["end"] <= at + width))
            return bound(inside, lambda i: F.struct((-F.size(F.array_distinct(i["k"]))).alias("n"), (F.coalesce(F.array_max(i["end"]), at) - at).alias("reach"), at.alias("at")))

        return F.array_min(F.transform(F.array_distinct(hits["at"]), rank))["at"]

    return bound(F.concat(*each), best) if each else F.lit(None).cast("int")


def snip_column(text: Column, terms: Sequence[str], width: int = EXCERPT_WIDTH) -> Column:
    """TXT12: the best window, moved left by a quarter, as one line, at word boundaries,
    dots where text was cut."""
    cut = lambda t, a, b: F.substring(t, a + 1, b - a)

    def inner(t: Column) -> Column:
        def at_words(s: Column) -> Column:
            gap = F.instr(cut(t, s["a"], F.least(s["a"] + 20, s["b"])), " ")
            return F.struct(F.when((s["a"] > 0) & (gap > 0), s["a"] + gap).otherwise(s["a"]).alias("a"), s["b"].alias("b"))

        def to_words(s: Column) -> Column:
            low = F.greatest(s["a"], s["b"] - 20)
            back = F.instr(F.reverse(cut(t, low, s["b"])), " ")
            gap = s["b"] - back
            return F.struct(s["a"].alias("a"), F.when((s["b"] < F.length(t)) & (back > 0) & (gap > s["a"]), gap).otherwise(s["b"]).alias("b"))

        def line(s: Column) -> Column:
            said = F.trim(F.regexp_replace(cut(t, s["a"], s["b"]), _BLANKS, " "))
            return F.concat(F.when(s["a"] > 0, DOTS).otherwise(""), said, F.when(s["b"] < F.length(t), DOTS).otherwise(""))

        begin = F.greatest(F.lit(0), F.coalesce(_window_start(F.lower(t), terms, width) - width // 4, F.lit(0)))
        span = bound(begin, lambda a: F.struct(a.alias("a"), F.least(F.length(t), a + width).alias("b")))
        whole = F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
        windowed = bound(bound(bound(span, at_words), to_words), line)
        return F.when((F.length(t) <= width) & ~F.contains(whole, F.lit("\n")), whole).otherwise(windowed)

    return bound(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), inner)


def context_line(text: Column, width: int = CONTEXT_WIDTH) -> Column:
    """TXT13: white space collapsed, cut to ``width``, dots if cut."""
    body = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.concat(F.substring(body, 1, width), F.when(F.length(body) > width, DOTS).otherwise(""))


def when(ts: Column) -> Column:
    """TXT14: minutes in the session's time zone, or undated."""
    return F.when(ts == 0, "undated").otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"))


def ago(ts: Column, now: float) -> Column:
    """TXT15."""
    d = F.greatest(F.lit(0.0), (F.lit(float(now)) - ts) / 86400.0)
    days = F.concat(F.floor(d).cast("string"), F.lit("d ago"))
    months = F.concat(F.floor(d / 30).cast("string"), F.lit("mo ago"))
    years = F.concat(F.format_string("%.1f", d / 365), F.lit("y ago"))
    return F.when(ts == 0, "?").when(d < 1, "today").when(d < 2, "yesterday").when(d < 60, days).when(d < 730, months).otherwise(years)
