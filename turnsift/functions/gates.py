"""Gates of patterns, worked out from the patterns themselves.

A gate is a cheap condition that holds for every text a pattern matches in.  It comes from
the parsed pattern: strings of which each match must hold one (``literals``), several such
sets where one says little, or, for a pattern made of character classes alone, the longest
run of classes that every match has (``core``).  Nothing is kept by hand beside the rules,
so a rule that changes takes its gate with it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, reduce
from operator import and_, or_
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sets larger than this are given up; a set of shorter strings than SURE wants a second one.
MOST, SURE = 64, 3
#: Letters beyond ASCII that case-blind matching takes for ASCII ones.
ALIKE = ("\u0131", "\u0130", "\u017f", "\u212a")
# End of the fixed values.


def parsed(pattern: str):
    """The tree of a pattern in Java's spelling."""
    return parser.parse(re.sub(r"\(\?<([a-z]+)>", r"(?P<\1>", pattern))


def _chars(members) -> list[str] | None:
    """The characters of a class that lists a few, or None."""
    out = []
    for op, value in members:
        if op is not sre.LITERAL:
            return None
        out.append(chr(value))
    return out


def _factors(items) -> tuple[set[str] | None, list[set[str]]]:
    """The strings that ``items`` can be, if they are few, and all sets of strings of which
    each match holds one."""
    found: list[set[str]] = []
    run: set[str] = {""}
    exact = True

    def close() -> None:
        nonlocal run, exact
        if run != {""}:
            found.append(run)
        run, exact = {""}, False

    def extend(strings: set[str]) -> None:
        nonlocal run
        if len(run) * len(strings) > MOST:
            close()
        run = {a + b for a in run for b in strings}

    for op, value in items:
        if op is sre.LITERAL:
            extend({chr(value)})
        elif op is sre.IN and (some := _chars(value)):
            extend(set(some))
        elif op is sre.SUBPATTERN:
            whole, inner = _factors(value[3])
            if whole:
                extend(whole)
            else:
                close()
                found += inner
        elif op is sre.BRANCH:
            each = [_factors(b) for b in value[1]]
            if all(w for w, _ in each) and len(set().union(*(w for w, _ in each))) <= MOST:
                extend(set().union(*(w for w, _ in each)))
            else:
                close()
                best = [_best([w] if w else f) for w, f in each]
                if all(best):
                    found.append(set().union(*best))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            whole, sets = _factors(inner)
            if least and whole and len(whole) ** least <= MOST:
                for _ in range(least):
                    extend(whole)
                if most != least:
                    close()
            else:
                close()
                found += sets if least else []
        elif op is sre.ASSERT:
            close()
            whole, sets = _factors(value[1])
            found += [whole] if whole else sets
        elif op not in (sre.ASSERT_NOT, sre.AT):
            close()
    whole = run if exact and run != {""} else None
    if run != {""}:
        found.append(run)
    return whole, [f for f in found if "" not in f]


def _best(sets: list[set[str]]) -> set[str] | None:
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _class(op, value) -> str | None:
    """One character class, or a character, in Java's spelling."""
    if op is sre.LITERAL:
        return re.escape(chr(value))
    if op is not sre.IN:
        return None
    body = ""
    for kind, x in value:
        if kind is sre.LITERAL:
            body += re.escape(chr(x))
        elif kind is sre.RANGE:
            # one by one: Java looks listed signs up in a bitmap, and ranges one after another
            body += "".join(re.escape(chr(c)) for c in range(x[0], x[1] + 1)) if x[1] < 128 else f"{re.escape(chr(x[0]))}-{re.escape(chr(x[1]))}"
        elif kind is sre.CATEGORY and x is sre.CATEGORY_DIGIT:
            body += r"\d"
        else:
            return None
    return body


def core(pattern: str) -> list[tuple[str, int]]:
    """The longest run of (class, times) that every match has."""
    best: list = []
    run: list = []

    def close() -> None:
        nonlocal best, run
        if sum(n for _, n in run) > sum(n for _, n in best):
            best = run
        run = []

    for op, value in parsed(pattern):
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        least, most, item = (1, 1, (op, value)) if op not in (sre.MAX_REPEAT, sre.MIN_REPEAT) else (value[0], value[1], value[2][0] if len(value[2]) == 1 else (None, None))
        body = _class(*item)
        if body is None or not least:
            close()
            continue
        run = [*run, (body, least)]
        if most != least:
            close()
    close()
    return best


@dataclass(frozen=True)
class Gate:
    """All of ``sets`` must have a member in the text, and the pattern, if any, a match."""

    sets: tuple[tuple[str, ...], ...]
    blind: bool = False
    pattern: str | None = None

    def holds(self, text: Column) -> Column:
        one = lambda t, s: reduce(or_, [F.contains(t, F.lit(x)) for x in s])
        cased = [s for s in self.sets if self.blind and any(x.lower() != x.upper() for x in s)]
        found = [one(text, s) for s in self.sets if s not in cased]
        if cased:  # the lower case is bound: no lambda shares what it computes twice
            low = F.exists(F.array(F.lower(text)), lambda t: reduce(and_, [one(t, s) for s in cased]))
            found.append(low | one(text, ALIKE))
        return reduce(and_, [*found, text.rlike(self.pattern)] if self.pattern else found)


def _minimal(strings: set[str]) -> tuple[str, ...]:
    """Without those that hold another one."""
    return tuple(sorted(s for s in strings if not any(t != s and t in s for t in strings)))


def _written(classes: list[tuple[str, int]]) -> str:
    return "(?U)" + "".join(f"[{c}]{{{n}}}" if n > 1 else f"[{c}]" for c, n in classes)


def long_run(text: Column, patterns: list[str]) -> Column:
    """For patterns that are each a run of one class: whether there is a run of any of their
    signs as long as the shortest of them.  Only where a run starts is it measured."""
    runs = [core(p) for p in patterns]
    signs = "".join(dict.fromkeys(re.findall(r"\\.|.", "".join(c for run in runs for c, _ in run))))
    least = min(n for run in runs for _, n in run)
    return F.concat(F.lit("\n"), text).rlike(f"[^{signs}][{signs}]{{{least}}}")


@cache
def gate_of(pattern: str) -> Gate:
    tree = parsed(pattern)
    blind = bool(tree.state.flags & re.I)
    _, sets = _factors(tree)
    sets = [set(_minimal({x.lower() for x in s} if blind else s)) for s in sets]
    best = _best(sets)
    if best is None:
        return Gate((), pattern=_written(core(pattern)))
    chosen = [best]
    if len(best) > 8 or min(map(len, best)) < SURE:
        second = _best([s for s in sets if s != best and len(s) <= 8])
        chosen = [second, best] if second else chosen
    classes = core(pattern) if len(chosen) == 1 and min(map(len, best)) == 1 else []
    run = _written(classes) if sum(n for _, n in classes) >= 4 else None
    return Gate(tuple(tuple(sorted(s)) for s in chosen), blind, run)
