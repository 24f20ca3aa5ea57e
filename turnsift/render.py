"""Shown rows as text or JSON (SNK9-SNK11).  Rows arrive redacted; nothing raw is read here."""

from __future__ import annotations

import json
from collections.abc import Iterable

from .schema import KIND_LABELS


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def _why(r) -> str:
    return f"kind {r['kind_pts']} + terms {r['terms_pts']} + phrase {r['phrase_pts']} + recency {r['recency_pts']}"


def label(kind: str) -> str:
    return KIND_LABELS.get(kind, kind)


def turn_block(r, context: Iterable = (), explain: bool = False) -> str:
    tool = f"/{r['tool']}" if r["tool"] else ""
    out = [f"[{r['score']:>3}] {r['when']}  {label(r['kind'])}{tool}  {r['project'] or '(no project)'}", f"      session {r['session_id'][:8]}  {r['source']}  {r['ago']}  seq {r['seq']}"]
    if explain:
        out.append(f"      why: {_why(r)} = {r['score']}")
    if r["target"]:
        out.append(f"      target: {r['target_line']}")
    near = sorted(context, key=lambda c: c["seq"])
    for c in near:
        sign = "-" if c["offset"] < 0 else "+"
        out.append(f"    > {r['excerpt']}" if c["offset"] == 0 else f"    {sign} [{label(c['kind'])}] {c['line']}")
    if not near:
        out.append(f"    > {r['excerpt']}")
    if r["truncated"]:
        out.append(f"      (turn was {r['orig_len']} chars, indexed to the limit)")
    return "\n".join(out)


def session_block(r, explain: bool = False) -> str:
    out = [f"[{r['score']:>3}] {r['last_when']}  {r['project'] or '(no project)'}  {r['source']}  session {r['session_id'][:8]}"]
    if r["title"]:
        out.append(f"      title: {r['title']}")
    out.append(f"      {r['hits']} matching turn(s)" + (f"; best hit scored {r['best']}" if explain else ""))
    if explain:
        out.append(f"      why: best {r['best']} ({_why(r)}) + {r['extra']} for repeat mentions = {r['score']}")
    return "\n".join([*out, f"      [{label(r['kind'])}] {r['excerpt']}"])


def turn_json(r) -> dict:
    points = {k: r[f"{k}_pts"] for k in ("kind", "terms", "phrase", "recency")}
    plain = {k: r[k] for k in ("session_id", "source", "project", "kind", "tool", "target", "ts", "when", "seq", "excerpt")}
    return {"score": r["score"], "parts": points, **plain, "transcript": r["path"]}


def session_json(r) -> dict:
    return {k: r[k] for k in ("score", "hits", "session_id", "source", "project")} | {"when": r["last_when"], "excerpt": r["excerpt"]}
