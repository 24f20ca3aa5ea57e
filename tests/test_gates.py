"""Gates come from the rules: each rule's own grammar must pass its gate."""

import random
import re
from re import _constants as sre

import pytest
from pyspark.sql import functions as F
from test_functions import column, masked, plainly

from turnsift.audit import detect
from turnsift.functions import gates, redact

CLASSES = {sre.CATEGORY_DIGIT: "0123456789", sre.CATEGORY_SPACE: " \t", sre.CATEGORY_NOT_SPACE: "aZ9-", sre.CATEGORY_WORD: "a_9"}


def members(items):
    if items[0][0] is sre.NEGATE:
        bad = set(members(items[1:])) | set(" \t\n" if (sre.CATEGORY, sre.CATEGORY_SPACE) in items else "")
        return [c for c in "aB3-x%" if c not in bad]
    out = []
    for op, x in items:
        out += [chr(x)] if op is sre.LITERAL else [chr(c) for c in range(x[0], x[1] + 1)] if op is sre.RANGE else list(CLASSES[x])
    return out


def example(rng, items, blind=False):
    """A string that the tree matches: few repeats, any branch."""
    out = ""
    for op, x in items:
        if op is sre.LITERAL:
            out += rng.choice([chr(x).lower(), chr(x).upper()]) if blind else chr(x)
        elif op is sre.IN:
            out += rng.choice(members(x))
        elif op is sre.ANY:
            out += rng.choice("a \n")
        elif op is sre.SUBPATTERN:
            out += example(rng, x[3], blind)
        elif op is sre.BRANCH:
            out += example(rng, rng.choice(x[1]), blind)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out += "".join(example(rng, x[2], blind) for _ in range(x[0] + rng.choice([0, 0, 1]) * (x[1] > x[0])))
        elif op is sre.ASSERT:
            out += example(rng, x[1], blind)
    return out


def examples(pattern, n=12):
    """Matches of the pattern, alone and between other signs."""
    rng, tree = random.Random(pattern), gates.parsed(pattern)
    python = re.sub(r"\(\?<([a-z]+)>", r"(?P<\1>", pattern)
    out = []
    while len(out) < n:
        s = example(rng, tree, bool(tree.state.flags & re.I))
        if re.search(python, s):
            out += [s, f"é {s}\n"]
    return out


PATTERNS = [*dict.fromkeys([*(p for _, p in redact.MASKED), *redact.HOMES, *(p for _, p in redact.NETWORK), redact.BASE64_RUN, redact.MIXED_RUN, redact.CONTROL, r"(?i)(?<![A-Za-z0-9])Alice\-b(?![A-Za-z0-9])"])]


def test_each_rule_passes_its_gate(spark):
    texts = [(p, s) for p in PATTERNS for s in examples(p)]
    df = spark.createDataFrame(texts, "p string, s string").cache()
    for p in PATTERNS:
        assert df.filter((F.col("p") == p) & ~gates.gate_of(p).holds(F.col("s"))).collect() == []


def test_each_rule_masks_what_it_would_without_gates(spark):
    texts = [s for p in PATTERNS for s in examples(p)]
    assert masked(spark, texts) == [plainly(t) for t in texts]
    assert all(r["text"] != t for r, t in zip(column(spark, texts, redact.redact), texts, strict=True) if plainly(t) != t)


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("my password = correcthorsebattery", "my password = [redacted:secret-assignment]"),
        ('x token = "abcdefghij y', 'x token = "[redacted:secret-assignment] y'),
        ("call ٥٥٥ ١٢٣ ٤٥٦٧", "call [redacted:phone]"),
        ("paſſword=abcdefgh12", "paſſword=[redacted:secret-assignment]"),
        ("BEARER \u212aabcdefghij1234567", "BEARER [redacted:bearer-token]"),
        ("toKen:abcdefgh12", "toKen:[redacted:secret-assignment]"),
    ],
)
def test_leaks_of_old(spark, text, shown):
    assert masked(spark, [text]) == [shown] == [plainly(text)]


def test_auditor_looks_at_every_signature(spark):
    texts = [s for _, p in detect.SIGNATURES for s in examples(p)]
    assert all(column(spark, texts, detect.suspicious))


def test_gates_of_patterns():
    assert gates.gate_of("ab(?:cd|ce)x").sets == (("abcdx", "abcex"),)
    assert gates.gate_of("a?b{2}c*").sets == (("bb",),)
    assert set(gates.gate_of("[xy]+z").sets) == {("x", "y"), ("z",)}
    assert gates.gate_of("(?<=key )[0-9]{3}").sets == (("key ",),)
    assert gates.gate_of("(?:ab|[0-9]+)[a-f]{4}").pattern == "(?U)[abcdef]{4}"
