"""The window rules in plain Python, to hold the Columns against."""

def close_together(found, terms, window=60) -> bool:
    """TXT7: from each place of the rarest term, take for each other term, in query order,
    its first place that keeps the span within ``window``; all placed: yes."""
    pivot = min(terms, key=lambda t: len(found[t]))
    others = [t for t in terms if t != pivot]
    for p in found[pivot]:
        span = (p, p + len(pivot))
        for t in others:
            grown = ((min(span[0], q), max(span[1], q + len(t))) for q in found[t])
            span = next((s for s in grown if s[1] - s[0] <= window), None)
            if span is None:
                break
        if span:
            return True
    return False


def places(hay, term) -> list[int]:
    out, at, low = [], -1, term.lower()
    while low and (at := hay.find(low, at + 1)) >= 0:
        out.append(at)
    return out


def best_window(text, terms, width=260) -> tuple[int, int]:
    """TXT11: of the windows that start at an occurrence, the one with most distinct terms
    wholly inside, then the tightest, then the first; moved left by a quarter."""
    low = text.lower()
    hits = sorted((p, p + len(t), t.lower()) for t in terms for p in places(low, t))
    if not hits:
        return 0, min(len(text), width)
    ranked = []
    for at in sorted({h[0] for h in hits}):
        inside = [h for h in hits if at <= h[0] and h[1] <= at + width]
        reach = max((h[1] for h in inside), default=at) - at
        ranked.append((-len({h[2] for h in inside}), reach, at))
    begin = max(0, min(ranked)[2] - width // 4)
    return begin, min(len(text), begin + width)


def snip(text, terms, width=260) -> str:
    """TXT12: the window as one line, at word boundaries, dots where text was cut."""
    text = (text or "").replace("\r", "")
    bare = text.strip()
    if len(text) <= width and "\n" not in bare:
        return bare
    a, b = best_window(text, terms, width)
    if a and (gap := text.find(" ", a, min(a + 20, b))) >= 0:
        a = gap + 1
    if b < len(text) and (gap := text.rfind(" ", max(a, b - 20), b)) > a:
        b = gap
    return "…" * (a > 0) + " ".join(text[a:b].split()) + "…" * (b < len(text))


