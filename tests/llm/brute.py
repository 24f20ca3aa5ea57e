"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def place(row):
    """Order of documents: null doc_id first; rows equal in both are one document."""
    return (row[0] is not None, row[0] or 0)


def repeats(rows, size, split):
    """What stays of each document, and the mask of what goes."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=place):
        w = split((text or "").encode())
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out[doc, text] = (w, gone)
    return out


def words_removed(rows, size=20):
    found = repeats(rows, size, lambda b: re.findall(rb"[^\x20\x09-\x0D]+", b))
    return {k: (len(w), sum(g), b" ".join(x for x, y in zip(w, g, strict=True) if not y)) for k, (w, g) in found.items()}


def bytes_removed(rows, size=100):
    found = repeats(rows, size, list)
    return {k: (len(w), sum(g), len(re.findall("1+", "".join("01"[x] for x in g))), bytes(x for x, y in zip(w, g, strict=True) if not y)) for k, (w, g) in found.items()}


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows, k, num, den=100):
    """Set sizes and components by comparing every pair."""
    sets = [(doc, shingles(text, k)) for doc, text in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            if a == b or s and t and den * len(s & t) >= num * len(s | t):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least.setdefault(top(i), []).append(doc)
    pick = lambda docs: min(docs, key=lambda d: (d is not None, d or 0))
    return sorted(((doc, len(s), pick(least[top(i)])) for i, (doc, s) in enumerate(sets)), key=repr)


def contaminated(rows, items, window=10):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            wins[tuple(w[i : i + m])].add(item)
    out = []
    for doc, text in rows:
        w = word.findall(lower(text))
        hit, own = set(), set()
        for m in {len(k) for k in wins}:
            for i in range(len(w) - m + 1):
                if (k := tuple(w[i : i + m])) in wins:
                    hit.update(range(i, i + m))
                    own |= {str(x) for x in wins[k] if x is not None}
        out.append((doc, len(w), len(hit), sorted(own)))
    return sorted(out, key=repr)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def sha(b):
    return hashlib.sha256(b).hexdigest()


__all__ = ["Counter", "base_spans", "bytes_removed", "contaminated", "linked", "lower", "luhn", "sha", "shingles", "words_removed"]
