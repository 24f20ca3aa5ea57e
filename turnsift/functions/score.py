"""The additive score: kind + terms + phrase + recency (TXT3-TXT9).

Everything is a Column over ``text``, ``target``, ``kind`` and ``ts``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KIND_POINTS, PHRASE_POINTS, PHRASE_WINDOW, RECENCY_BANDS, TERM_POINTS


def kind_points(kind: Column) -> Column:
    """TXT4."""
    out = F.lit(0)
    for name, points in KIND_POINTS.items():
        out = F.when(kind == name, points).otherwise(out)
    return out.cast("int")


def haystack(text: Column, target: Column) -> Column:
    return F.lower(F.concat(text, F.lit("\n"), target))


def terms_points(hay: Column, terms: Sequence[str]) -> Column:
    """TXT5: for each distinct typed term that occurs as a substring."""
    out = F.lit(0)
    for term in dict.fromkeys(terms):
        out = out + F.contains(hay, F.lit(term.lower())).cast("int")
    return (out * TERM_POINTS).cast("int")


def positions(hay: Column, term: str) -> Column:
    """TXT3: 0-based offsets of all occurrences, overlapping ones too: the text is cut
    before each, and the lengths of the pieces are added up."""
    low = term.lower()
    pieces = F.split(hay, f"(?={re.escape(low)})", -1)
    none = F.array().cast("array<int>")
    grown = lambda acc, piece: F.struct(F.concat(acc["at"], F.array(acc["n"])).alias("at"), (acc["n"] + F.length(piece)).alias("n"))
    starts = F.aggregate(pieces, F.struct(none.alias("at"), F.lit(0).alias("n")), grown, lambda acc: acc["at"])
    # the first piece starts at an occurrence only if the text does
    return F.when(hay.startswith(low), starts).when(F.contains(hay, F.lit(low)), F.slice(starts, 2, 1 << 30)).otherwise(none)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def close_together(found: Column, terms: Sequence[str], window: int = PHRASE_WINDOW) -> Column:
    """TXT7: from each place of the rarest term, take for each other term, in query order,
    its first place that keeps the span within ``window``; all placed: yes.  found: the
    array of each term's places."""
    size = lambda k: F.size(found[k])

    def grow(span: Column, k: int) -> Column:
        def wide(s: Column, q: Column) -> Column:
            return F.struct(F.least(s["lo"], q).alias("lo"), F.greatest(s["hi"], q + len(terms[k])).alias("hi"))

        def first(s: Column) -> Column:
            fits = F.filter(F.transform(found[k], lambda q: wide(s, q)), lambda w: w["hi"] - w["lo"] <= window)
            return F.when(s.isNotNull(), F.get(fits, 0))

        return bound(span, first)

    def around(k: int) -> Column:
        def placed(p: Column) -> Column:
            span = F.struct(p.alias("lo"), (p + len(terms[k])).alias("hi"))
            for other in range(len(terms)):
                if other != k:
                    span = grow(span, other)
            return span.isNotNull()

        return F.exists(found[k], placed)

    out = around(len(terms) - 1)
    for k in reversed(range(len(terms) - 1)):
        rarest = [size(k) <= size(j) for j in range(k + 1, len(terms))]
        out = F.when(reduce(and_, rarest), around(k)).otherwise(out)
    return out


def _one_after(hay: Column, a: str, b: str, window: int = PHRASE_WINDOW) -> Column:
    """Whether b starts at or after a place of a, both within the window: one linear scan."""
    if max(len(a), len(b)) > window:
        return F.lit(False)
    quoted = [re.escape(t.lower()) for t in (a, b)]
    return hay.rlike(f"(?s)(?={quoted[0]}).{{0,{window - len(b)}}}{quoted[1]}")


def phrase_points(hay: Column, terms: Sequence[str], found: Column) -> Column:
    """TXT6: a bonus if all typed terms (each counted) occur and stand close together."""
    distinct = list(dict.fromkeys(terms))
    if not terms or len(distinct) < len(terms):
        return F.lit(0)
    all_found = found == TERM_POINTS * len(terms)
    if len(terms) == 1:
        return F.when(all_found, PHRASE_POINTS).otherwise(0)
    if len(terms) == 2:
        near = _one_after(hay, *terms) | _one_after(hay, *reversed(terms))
        return F.when(all_found, F.when(near, PHRASE_POINTS).otherwise(0)).otherwise(0)

    near = bound(F.array(*[positions(hay, t) for t in terms]), lambda found: close_together(found, terms))
    return F.when(all_found, F.when(near, PHRASE_POINTS).otherwise(0)).otherwise(0)


def recency_points(ts: Column, now: float) -> Column:
    """TXT8: by age in days at ``now``, a bound value; the future is age 0, undated is 0."""
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - ts) / 86400.0)
    out = F.lit(0)
    for days, points in reversed(RECENCY_BANDS):
        out = F.when(age <= days, points).otherwise(out)
    return F.when(ts <= 0, 0).otherwise(out).cast("int")


def parts(terms: Sequence[str], now: float) -> dict[str, Column]:
    """The four components as Columns (over text, target, kind, ts)."""
    hay = haystack(F.col("text"), F.col("target"))
    found = terms_points(hay, terms)
    return {"kind_pts": kind_points(F.col("kind")), "terms_pts": found, "phrase_pts": phrase_points(hay, terms, found).cast("int"), "recency_pts": recency_points(F.col("ts"), now)}
