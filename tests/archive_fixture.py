"""A planted archive in all dialects, and a control with the needles replaced.

No complete credential is stored: shapes are put together from parts when it is written.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

BASE = datetime(2026, 6, 10, 9, tzinfo=UTC).timestamp()
NOW = BASE + 30 * 86400
DAY = 86400.0


def fill(n: int, letters: str = "aB3dE5gH7jK9mN2pQ4sT6vW8x") -> str:
    return "".join(letters[(7 * k + 3) % len(letters)] for k in range(n))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SECRETS = {
    "anthropic-key": "sk-" + "ant-" + fill(24),
    "openrouter-key": "sk-" + "or-v1-" + fill(30),
    "openai-key": "sk-" + "proj-" + fill(30),
    "github-token": "gh" + "p_" + fill(36),
    "aws-access-key-id": "AK" + "IA" + fill(16, UPPER),
    "google-api-key": "AI" + "za" + fill(35),
    "slack-token": "xo" + "xb-" + fill(20),
    "huggingface-token": "h" + "f_" + fill(30),
    "npm-token": "np" + "m_" + fill(36),
    "gitlab-token": "gl" + "pat-" + fill(20),
    "sendgrid-key": "S" + "G." + fill(20) + "." + fill(20),
    "stripe-key": "sk_" + "live_" + fill(24),
}


def iso(offset: float) -> str:
    return datetime.fromtimestamp(BASE + offset, UTC).isoformat().replace("+00:00", "Z")


def a(session: str, cwd: str, offset: float, kind: str, content=None, **more) -> dict:
    rec = {"sessionId": session, "cwd": cwd, "timestamp": iso(offset), "type": kind, "uuid": "u", "parentUuid": None, "isSidechain": False}
    if content is not None:
        rec["message"] = {"role": kind, "content": content}
    return rec | more


def use(name: str, call: str, **args) -> dict:
    return {"type": "tool_use", "id": call, "name": name, "input": args}


def result(call: str, text: str, error: bool = False) -> dict:
    return {"type": "tool_result", "tool_use_id": call, "is_error": error, "content": [{"type": "text", "text": text}]}


def sid(n: int, head: str = "aa11bb22") -> str:
    return f"{head}-0000-4000-8000-{n:012d}"


def write(root: Path, planted: bool = True) -> None:
    swap = (lambda s: s) if planted else (lambda s: s.replace("quaternion", "matrix").replace("pelican", "standard"))
    first = root / "claude-projects" / "-home-alice-Projects-tabula"
    second = root / "codex-sessions" / "2026" / "06" / "10"
    for p in (first, second):
        p.mkdir(parents=True)

    def put(path: Path, *records) -> None:
        path.write_bytes(("\n".join(swap(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for r in records) + "\n").encode())

    s, cwd = sid(1), "/home/alice/Projects/tabula"
    put(
        first / f"{s}.jsonl",
        a(s, cwd, 0, "user", "The CRLF importer drops the last row, please fix it"),
        a(s, cwd, 10, "assistant", [{"type": "thinking", "thinking": "Line ends, probably."}, {"type": "text", "text": "I'll look at the reader."}]),
        a(s, cwd, 20, "assistant", [use("Read", "t1", file_path="/home/alice/Projects/tabula/importer.py")]),
        a(s, cwd, 21, "user", [result("t1", "def read(path): ...")]),
        a(s, cwd, 30, "assistant", [use("Bash", "t2", command="pytest -q")]),
        a(s, cwd, 31, "user", [result("t2", "expected 3 rows, got 2", True)]),
        a(s, cwd, 40, "assistant", [use("Edit", "t3", file_path="importer.py", old_string="x", new_string="y")]),
        a(s, cwd, 41, "user", [result("t3", "ok")]),
        a(s, cwd, 50, "assistant", [use("Bash", "t4", command="pytest -q"), {"type": "text", "text": "Fixed."}]),
        a(s, cwd, 60, "attachment"),
        {"type": "ai-title", "aiTitle": "Importer loses a row", "sessionId": s},
        "{not json",
    )
    s = sid(2)
    log = "\n".join(f"line {k}: importer crlf rows expected" for k in range(60))
    put(first / f"{s}.jsonl", a(s, cwd, 100, "user", "what does this log say"), a(s, cwd, 101, "assistant", [use("Bash", "b1", command="cat log")]), a(s, cwd, 102, "user", [result("b1", log)]))
    s = sid(3)
    leaks = " ".join(SECRETS.values())
    put(first / f"{s}.jsonl", a(s, cwd, 200, "user", "deploy with " + leaks), a(s, cwd, 201, "assistant", [use("Bash", "c1", command="curl -u bob:hunter2secret@example.com http://10.1.2.3/")]), a(s, cwd, 202, "user", [result("c1", "nul \x00 byte, mail alice@example.org, call 555-123-4567")]))
    s = sid(4)
    put(first / f"{s}.jsonl", a(s, "/home/alice/Projects/decoy", 300, "user", "importer notes"), a(s, "/home/alice/Projects/decoy", 301, "user", "<system-reminder>be brief</system-reminder>", isMeta=True), a(s, "/home/alice/Projects/decoy", 302, "assistant", "Noted."))
    for n, offset in ((5, -700 * DAY), (15, 29 * DAY)):
        put(first / f"{sid(n)}.jsonl", a(sid(n), cwd, offset, "user", "flaky websocket reconnect in the client"))
    s = sid(6, "cc33dd44")
    item = lambda k, payload: {"timestamp": iso(400 + k), "type": "response_item", "payload": payload}
    put(
        second / f"rollout-{s}.jsonl",
        {"timestamp": iso(399), "type": "session_meta", "payload": {"session_id": s, "cwd": "/home/alice/Projects/rig"}},
        item(1, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "quaternion slerp for the camera rig"}]}),
        item(2, {"type": "reasoning", "summary": [{"type": "summary_text", "text": "use the short arc"}], "encrypted_content": "zzz"}),
        item(3, {"type": "custom_tool_call", "call_id": "k1", "name": "shell", "input": "cat rig.py"}),
        item(4, {"type": "custom_tool_call_output", "call_id": "k1", "output": [{"type": "text", "text": "class Rig: pass"}]}),
        item(5, {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "Done, slerp camera rig works."}]}),
        {"timestamp": iso(406), "type": "event_msg", "payload": {"type": "agent_message", "message": "Done, slerp camera rig works."}},
    )
    (root / "claude-history.jsonl").write_text(
        "\n".join(
            swap(json.dumps(r))
            for r in (
                {"display": "The CRLF importer drops the last row, please fix it", "timestamp": str(int(BASE * 1000)), "project": cwd, "sessionId": sid(1)},
                {"display": "", "timestamp": str(int(BASE * 1000)), "project": "/home/alice/Projects/wiki", "sessionId": sid(7, "ee55ff66")},
                {"display": "pelican migration plan for the wiki", "timestamp": str(int((BASE + 500) * 1000)), "project": "/home/alice/Projects/wiki", "sessionId": sid(7, "ee55ff66")},
            )
        )
        + "\n[1, 2]\n"
    )
