"""Command line: index, search, sessions, show, stats, audit, measure, export.

Exit codes: 0 hits; 1 none, or no such session; 2 a bad date; 3 the redactor fails its
own check; 4 an index inside the repository; 5 no index, or one of another schema.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import render
from .functions import excerpt
from .functions.redact import local_account, redact_fields, redact_strings, redact_text, self_check
from .operators import context, stats
from .operators.filters import Filters, parse_when
from .plans import search as plan
from .plans.index import build_index
from .schema import DEFAULT_LIMIT, DEFAULT_SCAN, KINDS, SOURCES
from .sources import store, work
from .sources.store import StoreError


def _spark() -> SparkSession:
    return SparkSession.builder.appName("turnsift").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _guard(spark) -> None:
    if not self_check(spark, local_account()):
        raise StoreError("the redactor fails its own check; nothing is shown", 3)


def _query(a) -> plan.Query:
    now = a.now if a.now is not None else time.time()
    try:
        since, until = parse_when(a.since, now), parse_when(a.until, now)
    except ValueError as e:
        raise StoreError(f"not a date: {e}", 2) from e
    side = {"only": True, "never": False}.get(a.sidechain)
    f = Filters(a.kind or (), a.tool or (), a.project, a.source or (), a.session, since, until, a.include_meta, side)
    return plan.Query(a.query, now, f, a.limit, a.scan, account=local_account())


class _Clock:
    """Seconds since the last lap."""

    def __init__(self):
        self.at, self.laps = time.time(), {}

    def lap(self, name: str) -> None:
        now = time.time()
        self.laps[name], self.at = now - self.at, now


def _footer(found: int, shown: int, unit: str, clock: _Clock) -> None:
    times = ", ".join(f"{k} {1000 * v:.0f} ms" for k, v in clock.laps.items())
    print(f"{found} matching turns, {shown} shown as {unit}  ({times})", file=sys.stderr)


def cmd_index(spark, a) -> int:
    meta, sources = build_index(spark, a.index, a.archive, a.source or ())
    missing = [s for s in sources if not s.exists]
    for s, root in zip(missing, redact_strings(spark, [s.root for s in missing], local_account()) if missing else [], strict=True):
        print(f"NOTE: source {s.name} is missing: {root}", file=sys.stderr)
    if not a.quiet:
        print("  ".join(f"{k}={v}" for k, v in sorted(meta.items())))
    return 0


def cmd_search(spark, a) -> int:
    _guard(spark)
    q, clock = _query(a), _Clock()
    turns, sessions, _ = store.read(spark, a.index)
    index, found, reads = store.read_terms(spark, a.index), None, None
    if a.best and q.terms:
        hits, reads = plan.best_hits(index, sessions, q)
    else:
        found = plan.scored(turns, sessions, q, index).cache()
        n = found.count()
        clock.lap("match")
        hits = plan.top_of(found, q).cache()
    rows = plan.shown(hits, q).collect()
    clock.lap("rank")
    near: dict = {}
    if a.context and rows and not a.json:
        for c in plan.around(hits, turns, q, a.context).collect():
            near.setdefault(c["hit_id"], []).append(c)
        clock.lap("context")
    if a.json:
        print(render.dumps([render.turn_json(r) for r in rows]))
    else:
        for r in rows:
            print(render.turn_block(r, near.get(r["turn_id"], ()), a.explain), end="\n\n")
        if reads:
            print(f"{len(rows)} best turns; read {reads.read} of {reads.blocks} blocks that hold the terms", file=sys.stderr)
        else:
            _footer(n, len(rows), "turns", clock)
    if found is not None:
        hits.unpersist()
        found.unpersist()
    return 0 if rows else 1


def cmd_sessions(spark, a) -> int:
    _guard(spark)
    q, clock = _query(a), _Clock()
    turns, sessions, _ = store.read(spark, a.index)
    found = plan.scored(turns, sessions, q, store.read_terms(spark, a.index)).cache()
    n = found.count()
    clock.lap("match")
    last = F.when(F.col("last_ts") > 0, F.col("last_ts")).otherwise(F.col("ts"))
    rows = plan.shown(plan.sessions_of(found, q), q).withColumn("last_when", excerpt.when(last)).collect()
    clock.lap("rank")
    if a.json:
        print(render.dumps([render.session_json(r) for r in rows]))
    else:
        for r in rows:
            print(render.session_block(r, a.explain), end="\n\n")
        _footer(n, len(rows), "sessions", clock)
    found.unpersist()
    return 0 if rows else 1


def cmd_show(spark, a) -> int:
    _guard(spark)
    turns, sessions, _ = store.read(spark, a.index)
    head = context.find_session(sessions, a.session).withColumn("when", excerpt.when(F.col("last_ts")))
    head = redact_fields(head, {c: F.col(c) for c in ("project", "title")}, local_account()).collect()
    if not head:
        print(f"no session starting {a.session!r} in the index", file=sys.stderr)
        return 1
    print(f"session {'  '.join(str(head[0][c]) for c in ('session_id', 'source', 'project', 'when'))}")
    if head[0]["title"]:
        print(f"title: {head[0]['title']}")
    window = context.show_window(turns, sessions, a.session, a.seq, a.span)
    for t in redact_fields(window, {"line": excerpt.context_line(F.col("text"), a.width), "tool": F.col("tool")}, local_account()).collect():
        name = "/".join(filter(None, (render.label(t["kind"]), t["tool"])))
        print(f"\n{t['seq']:>4} [{name}]\n     {t['line']}")
    return 0


#: What stats prints: a heading, the field it comes from, how to write it.
STATS = (
    ("index", "path", "{}"), ("size", "size_mb", "{:.1f} MB"), ("sessions", "sessions", "{}"), ("turns", "turns", "{}"), ("projects", "projects", "{}"), ("span", "span", "{}"),
    ("built in", "built", "{}"), ("by source", "by_source", "{}"), ("by kind", "by_kind", "{}"), ("top tools", "by_tool", "{}"), ("skipped", "skipped", "{}"),
)


def cmd_stats(spark, a) -> int:
    _guard(spark)
    turns, sessions, meta = store.read(spark, a.index)
    groups = {"by_source": stats.by_source(sessions), "by_kind": stats.by_kind(turns), "by_tool": stats.top_tools(turns)}
    parts = [df.select(F.lit(k).alias("part"), F.col(df.columns[0]).alias("name"), F.col(df.columns[1]).alias("n")) for k, df in groups.items()]
    names = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("name", redact_text(F.col("name"), local_account()))
    found: dict = {k: {} for k in groups}
    for r in names.orderBy("part", F.desc("n"), "name").collect():
        found[r["part"]][r["name"]] = r["n"]
    day = lambda c: F.substring(excerpt.when(F.col(c)), 1, 10)
    t = stats.totals(turns, sessions).withColumn("span", F.concat_ws(" to ", day("first_ts"), day("last_ts"))).first().asDict()
    size = store.size_bytes(spark, a.index)
    if a.json:
        span = t.pop("span")
        print(render.dumps({"size_bytes": size, "span": span, **t, **found}))
        return 0
    listed = {k: ", ".join(f"{n}={c}" for n, c in list(v.items())[: 10 if k == "by_tool" else None]) for k, v in found.items()}
    skipped = ", ".join(f"{meta.get(k, 0)} {what}" for k, what in (("attachment", "attachments"), ("encrypted", "encrypted blobs"), ("bad_json", "unparseable lines")))
    fields = {**t, **listed, "path": redact_strings(spark, [a.index], local_account())[0], "size_mb": size / 1e6, "built": f"{meta.get('build_seconds')}s from {meta.get('files')} files", "skipped": skipped}
    for heading, field, form in STATS:
        print(f"{heading:<14}{form.format(fields[field])}")
    return 0


def cmd_audit(spark, a) -> int:
    """LEK33.  Audits the index as it would be shown; files named, or those below folders;
    with --tree what git tracks there; ``-`` is what comes on standard input.  Of files,
    each finding is listed with its place."""
    from .audit import detect

    if a.path or a.tree:
        return _audit_files(spark, a)
    turns, _, _ = store.read(spark, a.index)
    found = detect.findings(plan.audit_ready(turns, local_account()), "turn_id")
    rows = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("snippet").alias("x")).select("label", "n", detect.shorten(F.col("x")).alias("x")).orderBy(F.desc("n"), "label").collect()
    for r in rows:
        print(f"{r['n']:>6}  {r['label']}  {r['x']}")
    total = sum(r["n"] for r in rows)
    print(f"{total} findings")
    return 0 if total == a.expect_findings else 1


def _audit_files(spark, a) -> int:
    """LEK30, LEK31, AGG13."""
    from .audit import detect

    given = a.path == ["-"]
    paths = [work.spool(spark, sys.stdin.buffer, "stdin")] if given else [*a.path, *(detect.tracked_files(a.tree) if a.tree else ())]
    found = detect.scan_records(detect.read_records(spark, paths, a.glob), not a.nul_only).withColumn("path", F.lit("<stdin>") if given else F.col("path"))
    if a.strict or given:
        found = found.withColumn("exempt", F.lit(False))
    found = found.cache()
    if a.count_markers:
        marked = found.filter("exempt").select("path", "line").distinct().orderBy("path", "line")
        for r in marked.toLocalIterator():
            print(f"{r['path']}:{r['line']}")
        print(f"{marked.count()} marked line(s)")
        return 0
    by_input = detect.per_input(found).cache()
    total = by_input.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("inputs")).first()
    if not a.quiet:
        listed = found.filter("not exempt").select("path", "line", "label", detect.shorten(F.col("snippet")).alias("x")).orderBy("path", "line", "label", "x")
        for r in listed.toLocalIterator():
            print(f"LEAK {r['path']}:{r['line']}: {r['label']}: {r['x']}")
        for r in by_input.orderBy(F.desc("n"), "path").toLocalIterator():
            print(f"{r['n']:>6}  {r['path']}")
        print(f"{total['n']} findings in {total['inputs']} input(s)")
    found.unpersist()
    by_input.unpersist()
    return 0 if total["n"] == a.expect_findings else 1


def cmd_export(spark, a) -> int:
    """SNK12, SNK13.  Redacted turns as JSON lines, written only if an audit finds nothing."""
    from .plans.export import export_corpus

    _guard(spark)
    turns, sessions, _ = store.read(spark, a.index)
    n = export_corpus(turns, sessions, a.out, a.now if a.now is not None else time.time(), local_account())
    if n:
        print(f"{n} findings after redaction; nothing was written", file=sys.stderr)
    return 1 if n else 0


def cmd_measure(spark, a) -> int:
    """AGG14, AGG15.  Times the fixed queries; with counts recorded as JSON (name: number),
    reports those that have moved."""
    from .plans import measure

    turns, sessions, _ = store.read(spark, a.index)
    now = a.now if a.now is not None else time.time()
    print(render.dumps(measure.latencies(turns, sessions, now, index=store.read_terms(spark, a.index))))
    if not a.recorded:
        return 0
    total = stats.totals(turns, sessions)
    counted = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in ("sessions", "turns", "projects")])).alias("x")).select("x.*")
    with open(a.recorded) as f:
        recorded = spark.createDataFrame([(k, int(v)) for k, v in json.load(f).items()], "name string, n long")
    moved = measure.drifted(counted, recorded).orderBy("name").collect()
    for r in moved:
        print(f"{r['name']}: recorded {r['was']}, now {r['now']}")
    return 1 if moved else 0


_FLAG, _MANY = {"action": "store_true"}, {"action": "append"}
_ASKED = {
    "query": {}, "--kind": _MANY | {"choices": KINDS}, "--tool": _MANY, "--source": _MANY | {"choices": SOURCES}, "--project": {}, "--session": {}, "--since": {}, "--until": {},
    "--limit": {"type": int, "default": DEFAULT_LIMIT}, "--scan": {"type": int, "default": DEFAULT_SCAN}, "--context": {"type": int, "default": 1},
    "--explain": _FLAG, "--json": _FLAG, "--include-meta": _FLAG, "--sidechain": {"choices": ["only", "never", "both"], "default": "both"},
}
#: command: (what runs it, its arguments)
COMMANDS = {
    "index": (cmd_index, {"--archive": {}, "--source": _MANY | {"choices": SOURCES}, "--quiet": _FLAG}),
    "search": (cmd_search, _ASKED | {"--best": _FLAG}),
    "sessions": (cmd_sessions, _ASKED),
    "show": (cmd_show, {"session": {}, "--seq": {"type": int, "default": 0}, "--span": {"type": int, "default": 5}, "--width": {"type": int, "default": 400}}),
    "stats": (cmd_stats, {"--json": _FLAG}),
    "audit": (cmd_audit, {"path": {"nargs": "*"}, "--glob": {"default": "*"}, "--tree": {}, "--strict": _FLAG, "--count-markers": _FLAG, "--quiet": _FLAG, "--nul-only": _FLAG, "--expect-findings": {"type": int, "default": 0}}),
    "measure": (cmd_measure, {"--recorded": {}}),
    "export": (cmd_export, {"out": {}}),
}


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="turnsift", description="Search, rank and safely show transcripts.")
    ap.add_argument("--index", default=store.default_path())
    ap.add_argument("--now", type=float, help="epoch seconds to count ages from")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name, (run, arguments) in COMMANDS.items():
        p = sub.add_parser(name)
        for argument, options in arguments.items():
            p.add_argument(argument, **options)
        p.set_defaults(fn=run)
    return ap


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.cmd == "index":
            store.guard(a.index)
        return a.fn(spark or _spark(), a)
    except StoreError as e:
        print(str(e), file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
