"""End to end over the planted archive, with the control for every positive."""

import contextlib
import io
import json

import pytest
from archive_fixture import DAY, NOW, SECRETS, sid, write
from pyspark.sql import functions as F

from turnsift import cli
from turnsift.audit.detect import findings
from turnsift.operators.filters import Filters
from turnsift.plans import export, measure
from turnsift.plans import search as plan
from turnsift.plans.index import build_index
from turnsift.sources import store


@pytest.fixture(scope="session")
def index(spark, tmp_path_factory):
    out = {}
    for name, planted in (("planted", True), ("control", False)):
        root = tmp_path_factory.mktemp(name)
        write(root / "archive", planted)
        meta, sources = build_index(spark, f"{root}/index", f"{root}/archive", home="/home/alice")
        assert all(s.exists for s in sources)
        out[name] = (f"{root}/index", *store.read(spark, f"{root}/index")[:2], meta)
    return out


def find(index, text, where="planted", limit=10, **filters):
    _, turns, sessions, _ = index[where]
    return plan.turn_hits(turns, sessions, plan.Query(text, NOW, Filters(**filters), limit)).collect()


def test_counts(index):
    _, turns, sessions, meta = index["planted"]
    assert sessions.count() == 8
    assert meta["bad_json"] == 2 and meta["attachment"] == 1 and meta["encrypted"] == 1
    kinds = {r["kind"]: r["count"] for r in turns.groupBy("kind").count().collect()}
    assert kinds["error"] == 1 and kinds["meta"] == 1 and kinds["thinking"] == 2
    assert sum(kinds.values()) == meta["kind_user_request"] + sum(v for k, v in meta.items() if k.startswith("kind_") and k != "kind_user_request")


def test_session_values(index):
    _, turns, sessions, _ = index["planted"]
    s = {r["session_id"]: r for r in sessions.collect()}
    one = s[sid(1)]
    assert (one["title"], one["project"], one["turns"]) == ("Importer loses a row", "~/Projects/tabula", 11)
    assert s[sid(7, "ee55ff66")]["source"] == "claude_prompts" and s[sid(1)]["source"] == "claude_code"
    seqs = [r["seq"] for r in turns.filter(F.col("session_key") == one["session_key"]).orderBy("seq").collect()]
    assert seqs == list(range(11))
    gappy = turns.filter(F.col("session_key") == s[sid(7, "ee55ff66")]["session_key"]).collect()
    assert [r["seq"] for r in gappy] == [1]  # the empty prompt keeps its place


def test_tool_names_follow_the_call(index):
    _, turns, sessions, _ = index["planted"]
    r = turns.filter("kind = 'error'").first()
    assert r["tool"] == "Bash" and r["text"] == "expected 3 rows, got 2"
    order = [x["kind"] for x in turns.filter("source = 'codex'").orderBy("seq").collect()]
    assert order == ["user_request", "thinking", "tool_input", "tool_output", "assistant_text"]


@pytest.mark.parametrize(
    ("text", "session", "kind", "in_control"),
    [
        ("crlf importer", sid(1), "user_request", True),
        ("expected 3 rows", sid(1), "error", True),
        ("importer.py", sid(1), "tool_input", True),
        ("quaternion slerp", sid(6, "cc33dd44"), "user_request", False),
        ("pelican migration", sid(7, "ee55ff66"), "user_request", False),
        ("flaky websocket reconnect", sid(15), "user_request", True),
    ],
)
def test_known_answers(index, text, session, kind, in_control):
    best = find(index, text)[0]
    assert (best["session_id"], best["kind"]) == (session, kind)
    assert bool(find(index, text, "control")) == in_control


def test_filters(index):
    assert not find(index, "system-reminder")
    assert find(index, "system-reminder", include_meta=True)
    assert len(find(index, "websocket", since=NOW - 7 * DAY)) == 1
    assert len(find(index, "websocket", until=NOW - 365 * DAY)) == 1
    assert {r["kind"] for r in find(index, "importer", kind=["tool_input"])} == {"tool_input"}
    assert {r["tool"] for r in find(index, "pytest", tool=["bASH"])} == {"Bash"}
    assert {r["project"] for r in find(index, "importer", project="DECOY")} == {"~/Projects/decoy"}
    assert {r["source"] for r in find(index, "slerp", source=["codex"])} == {"codex"}
    assert {r["session_id"] for r in find(index, "importer", session="aa11")} <= {sid(k) for k in range(1, 16)}
    assert not find(index, "importer --")  # a term without tokens matches nothing
    assert not find(index, "import")  # no prefixes


def test_sessions_and_context(index):
    _, turns, sessions, _ = index["planted"]
    q = plan.Query("importer", NOW, limit=5)
    ranked = plan.session_hits(turns, sessions, q).collect()
    assert ranked[0]["session_id"] == sid(1) and ranked[0]["score"] == ranked[0]["best"] + min(5, ranked[0]["hits"] - 1)
    hits = plan.turn_hits(turns, sessions, q)
    near = plan.around(hits, turns, q).collect()
    assert {c["offset"] for c in near} == {-1, 0, 1}


def test_nothing_leaks(spark, index):
    _, turns, sessions, _ = index["planted"]
    raw = findings(turns, "turn_id").count()
    assert raw > 8
    assert findings(plan.audit_ready(turns, "alice"), "turn_id").collect() == []
    shown = plan.shown(plan.turn_hits(turns, sessions, plan.Query("deploy", NOW)), plan.Query("deploy", NOW)).collect()
    assert shown and not any(s in str(r) for r in shown for s in SECRETS.values() if len(s) > 20 and s in r["excerpt"])


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
        code = cli.main(["--now", str(NOW), *argv], spark)
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, index, tmp_path):
    path = index["planted"][0]
    code, out, _ = run(spark, "--index", path, "search", "crlf importer", "--json")
    assert code == 0 and json.loads(out)[0]["parts"] == {"kind": 5, "terms": 4, "phrase": 3, "recency": 2}
    code, out, _ = run(spark, "--index", path, "search", "crlf importer", "--explain")
    assert code == 0 and "why: kind 5 + terms 4 + phrase 3 + recency 2 = 14" in out
    assert all(len(block.splitlines()) <= 8 for block in out.split("\n\n"))
    assert run(spark, "--index", path, "search", "nosuchword")[0] == 1
    code, best, err = run(spark, "--index", path, "search", "crlf importer", "--best", "--json")
    assert code == 0 and best == run(spark, "--index", path, "search", "crlf importer", "--json")[1] and "blocks" not in err
    assert "1 best turns; read 1 of 1 blocks" in run(spark, "--index", path, "search", "quaternion", "--best", "--limit", "1")[2]
    assert run(spark, "--index", path, "search", "x", "--since", "junk")[0] == 2
    assert run(spark, "--index", str(cli.__file__).replace("cli.py", "here"), "index")[0] == 4
    assert run(spark, "--index", f"{tmp_path}/none", "stats")[0] == 5
    code, out, _ = run(spark, "--index", path, "sessions", "importer")
    assert code == 0 and "matching turn(s)" in out
    code, out, _ = run(spark, "--index", path, "show", "cc33dd44", "--seq", "2", "--span", "1")
    assert code == 0 and "tool call/shell" in out
    assert run(spark, "--index", path, "show", "zz")[0] == 1
    code, out, _ = run(spark, "--index", path, "stats", "--json")
    assert code == 0 and '"sessions": 8' in out
    code, out, err = run(spark, "--index", path, "stats")
    assert code == 0 and " to 20" in out and not err
    code, _, err = run(spark, "--index", path, "search", "importer")
    assert code == 0 and "matching turns" in err and "match " in err and "rank " in err
    assert run(spark, "--index", path, "audit")[0] == 0
    leak = tmp_path / "leak.txt"
    leak.write_text("mail a@example.com")
    assert run(spark, "audit", str(leak))[0] == 1 and run(spark, "audit", str(leak), "--expect-findings", "1")[0] == 0
    assert run(spark, "audit", str(leak), "--nul-only")[0] == 0
    leak.write_text("fine\nmail a@example.com\nb@example.com  synthetic-fixture\n")
    code, out, _ = run(spark, "audit", str(leak))
    assert code == 1 and f"LEAK {leak}:2: email address: a@exam…" in out and "1 findings in 1 input(s)" in out
    assert run(spark, "audit", str(leak), "--strict", "--expect-findings", "2", "--quiet") == (0, "", "")
    code, out, _ = run(spark, "audit", str(leak), "--count-markers")
    assert code == 0 and out == f"{leak}:3\n1 marked line(s)\n"


def test_measure(spark, index, tmp_path):
    path, turns, sessions, _ = index["planted"]
    found = measure.latencies(turns, sessions, NOW, ["importer", "slerp"])
    assert 0 < found["query_ms_median"] <= found["query_ms_max"]
    for n, code in ((8, 0), (80, 1)):
        (tmp_path / "was.json").write_text(json.dumps({"sessions": n, "turns": turns.count(), "projects": sessions.select("project").distinct().count()}))
        got, out, _ = run(spark, "--index", path, "measure", "--recorded", f"{tmp_path}/was.json")
        assert got == code and "query_ms_median" in out and ("sessions: recorded 80, now 8" in out) == bool(code)


def test_export_waits_for_the_audit(spark, index, tmp_path, monkeypatch):
    path, turns, sessions, _ = index["planted"]
    assert run(spark, "--index", path, "export", f"{tmp_path}/corpus")[0] == 0
    rows = spark.read.json(f"{tmp_path}/corpus")
    assert rows.count() == turns.count() and "turn_id" not in rows.columns
    lines = [json.loads(x) for p in sorted((tmp_path / "corpus").glob("part-*")) for x in p.read_text().splitlines()]
    joined = turns.join(sessions.select("session_key", "session_id"), "session_key").orderBy("session_id", "seq").collect()
    assert [(x["session"], x["seq"], x["kind"]) for x in lines] == [(r["session_id"][:8], r["seq"], r["kind"]) for r in joined]
    assert {x["age_days"] for x in lines} == {round((NOW - r["ts"]) / DAY) if r["ts"] else None for r in joined} and max(len(x["text"]) for x in lines) <= 1200
    with pytest.raises(FileExistsError):
        export.export_corpus(turns, sessions, f"{tmp_path}/corpus", NOW)
    monkeypatch.setattr(export, "redact_fields", lambda df, fields, account=None: df)
    assert export.export_corpus(turns, sessions, f"{tmp_path}/raw", NOW) > 0 and not list(tmp_path.glob("raw*"))
