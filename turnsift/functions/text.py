"""Parse-time scalars and search tokens as Columns (PRJ1-PRJ3, PRJ6, PRJ7, TXT1, TXT2).

Java's ``\\s`` and ``\\b`` are ASCII unless ``(?U)`` says otherwise, so it is written out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_TEXT

# What marks a failed tool result, at a line start in the first 400 characters.
ERROR_SIGNS = (
    r"Traceback \(most recent call last\)",
    r"[A-Za-z_.]*(?:Error|Exception)(?U:\s)*:",
    r"error\[E(?U:\d)+\]",
    r"fatal:",
    r"FAIL(?:ED)?(?U:\b)",
    r"npm ERR!",
    r"command not found",
    r"Permission denied",
    r"exit (?:code )?[1-9](?U:\d)*",
)
ERROR_PATTERN = r"(?:^|\n)(?U:\s)*(?:" + "|".join(ERROR_SIGNS) + ")"


def collapse_home(path: Column, home: str) -> Column:
    """PRJ1: the home directory, or what lies under it, with ~ for it."""
    inside = (path == home) | path.startswith(home.rstrip("/") + "/")
    return F.when(inside, F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def epoch_seconds(stamp: Column) -> Column:
    """PRJ2: digits (milliseconds above 1e11) or ISO text to seconds; 0.0 if neither."""
    s = F.trim(stamp)
    number = F.when(s.rlike("^[0-9]+$"), s.cast("double"))
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    iso = F.unix_micros(F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s))) / F.lit(1e6)
    return F.coalesce(seconds, iso, F.lit(0.0))


def clip(text: Column, most: int = MAX_TEXT) -> Column:
    """PRJ3: struct of text, truncated and orig_len (code points before the cut)."""
    whole = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?U)^\s+|\s+$", "")
    return F.struct(F.substring(whole, 1, most).alias("text"), (F.length(whole) > most).alias("truncated"), F.length(whole).alias("orig_len"))


def decode_project_dir(name: Column, home: str) -> Column:
    """PRJ6: a flattened directory name back to a path, as far as that can be told."""
    path = F.concat(F.lit("/"), F.replace(F.substring(name, 2, 1 << 30), F.lit("-"), F.lit("/")))
    return F.when(name.startswith("-"), collapse_home(path, home)).otherwise(name)


def result_kind(text: Column, flagged: Column) -> Column:
    """PRJ7: error if flagged or if the first 400 characters show a sign of one."""
    return F.when(flagged | F.substring(text, 1, 400).rlike(ERROR_PATTERN), "error").otherwise("tool_output")


@cache
def fold_table() -> tuple[str, str]:
    """Lower-case letters of any script whose canonical decomposition is one letter and
    marks, and those letters; the last sigma of a word is a sigma.  (Hangul syllables and
    others that decompose into several letters stay.)"""
    pairs = {"\u03c2": "\u03c3"}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x30000))):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c and c == c.lower():
            pairs[c] = pairs.get(bare, bare)
    return "".join(pairs), "".join(pairs.values())


def fold(text: str | None) -> str:
    """Search tokens between single spaces: letters and digits, lower case, no accents."""
    plain = (text or "").lower()
    if not plain.isascii():
        plain = plain.translate(str.maketrans(*fold_table()))
        plain = "".join(c for c in plain if unicodedata.category(c) != "Mn")
    tokens = re.findall(r"[^\W_]+", plain)
    return f" {' '.join(tokens)} " if tokens else ""


def fold_column(text: Column) -> Column:
    """fold, JVM-side: a lookup for each letter, in texts that aren't ASCII, and marks
    removed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(F.translate(low, *fold_table()), r"\p{Mn}+", "")
    return _spaced(F.when(low.rlike(r"[^\x00-\x7f]"), bare).otherwise(low))


def _spaced(text: Column) -> Column:
    """The runs of letters and digits between single spaces."""
    bare = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def tokens_sql(text: Column) -> Column:
    """The same tokens without folding accents, JVM-side (tables without an index)."""
    return _spaced(F.lower(text))


def split_query(query: str) -> list[str]:
    """TXT1: terms between white space; a quote at a term's start opens a span to the next
    quote, or to the end of the query."""
    pattern = re.compile(r'"([^"]*)(?:"|\Z)|(\S+)')
    found, at = [], 0
    while m := pattern.search(query, at):
        found.append(m[1] if m[2] is None else m[2])
        at = max(m.end(), at + 1)
    return [t for t in found if t.strip()]


def matches(terms: Iterable[str], text_tok: str = "text_tok", target_tok: str = "target_tok", folded: bool = True) -> Column:
    """TXT2: every term is a run of whole tokens of the text or of the target.  A term
    without tokens matches nothing."""
    out = F.lit(True)
    for term in terms:
        key = fold(term) if folded else _plain(term)
        out = out & ((F.contains(F.col(text_tok), F.lit(key)) | F.contains(F.col(target_tok), F.lit(key))) if key else F.lit(False))
    return out


def term_tokens(term: str, folded: bool = True) -> list[str]:
    """The tokens of a term, as ``matches`` looks for them."""
    return (fold(term) if folded else _plain(term)).split()


def _plain(term: str) -> str:
    tokens = re.findall(r"[^\W_]+", term.lower())
    return f" {' '.join(tokens)} " if tokens else ""
