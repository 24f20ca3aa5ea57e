"""Transcript lines to typed turns and sessions (SRC6-SRC9, PRJ4-PRJ11, JON3-JON4, WIN1-WIN3).

One Arrow function, ``emissions``, looks at each line alone: the JSON of the dialects is
polymorphic (a string or nested lists, numbers or strings), which no fixed schema states
without loss.  Whatever depends on order is SQL over its rows, in chunks of lines: tool
names as of the latest call, dense numbering; the last session values of a file, counters.

Deviation on purpose: a prompt-history line that is JSON but no object counts as
unparseable instead of ending the run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, collapse_home, decode_project_dir, fold_column, result_kind
from ..operators.segments import latest, line_splits, number_lines, running_number
from ..schema import MAX_TEXT
from .work import put

# Argument names that say what a tool was used on, first one wins.
TARGET_NAMES = ("file_path", "notebook_path", "path", "command", "url", "pattern", "query", "prompt", "description", "skill", "content")
META_ROLES = ("developer", "system", "tool")
COLUMNS = {
    "source": "string", "path": "string", "line_no": "int", "start": "long", "at": "long", "pos": "int", "role": "string", "call": "string", "tool": "string",
    "target": "string", "body": "string", "flagged": "boolean", "side": "boolean", "ts": "double", "sid": "string", "cwd": "string",
    "title": "string", "note": "string",
}
_ARROW = pa.schema([(k, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for k, t in COLUMNS.items()])


def plain_text(value) -> str:
    """PRJ4: the text of a string, of a block's ``text``, or of any nesting of lists."""
    if isinstance(value, list):
        return "\n".join(filter(None, map(plain_text, value)))
    if isinstance(value, dict):
        value = value.get("text")
    return value if isinstance(value, str) else ""


def target_of(args) -> str:
    """PRJ5: the first telling string argument, else the first string that isn't blank."""
    if not isinstance(args, dict):
        return str(args)[:200] if args else ""
    ordered = [args.get(k) for k in TARGET_NAMES] + list(args.values())
    return next((v.strip()[:400] for v in ordered if isinstance(v, str) and v.strip()), "")


def seconds(stamp) -> float:
    """PRJ2 on a JSON value.  Text without an offset is UTC."""
    if isinstance(stamp, str):
        stamp = stamp.strip()
        if not stamp.isdigit():
            try:
                at = datetime.fromisoformat(stamp.replace("Z", "+00:00"))
                return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()
            except ValueError:
                return 0.0
    try:
        n = float(stamp or 0)
    except (TypeError, ValueError):
        return 0.0
    return n / 1000 if n > 1e11 else n


def _load(raw: str):
    try:
        rec = json.loads(raw)
    except ValueError:
        return None
    return rec if isinstance(rec, dict) else None


def _text(value) -> str:
    return value if isinstance(value, str) else ("" if not value else str(value))


def _spoken(kind: str, text) -> dict:
    return {"role": kind, "body": _text(text)}


def _call(name, call_id, target: str, body: str) -> dict:
    name = _text(name)
    return {"role": "tool_input", "tool": name, "call": json.dumps(call_id), "target": target, "body": f"{name} {body}"}


def _result(call_id, content, flagged: bool) -> dict:
    return {"role": "result", "call": json.dumps(call_id), "body": plain_text(content), "flagged": flagged}


def _blocks(rec: dict) -> Iterator[dict]:
    """Turns of one record of the first dialect."""
    kind = rec.get("type")
    if kind == "system":
        if text := plain_text(rec.get("content")):
            yield _spoken("meta", text)
        return
    said = "meta" if rec.get("isMeta") else {"user": "user_request"}.get(kind, "assistant_text")
    message = rec.get("message")
    content = message.get("content") if isinstance(message, dict) else None
    if isinstance(content, str):
        yield _spoken(said, content)
    for block in content if isinstance(content, list) else ():
        match block:
            case {"type": "text"}:
                yield _spoken(said, block.get("text"))
            case {"type": "thinking"}:
                yield _spoken("thinking", block.get("thinking") or block.get("text"))
            case {"type": "tool_use"}:
                args = block.get("input")
                yield _call(block.get("name"), block.get("id"), target_of(args), json.dumps(args, ensure_ascii=False))
            case {"type": "tool_result"}:
                yield _result(block.get("tool_use_id"), block.get("content"), bool(block.get("is_error")))


def _items(payload: dict) -> Iterator[dict]:
    """Turns of one response item of the second dialect."""
    match payload.get("type"):
        case "message":
            role = payload.get("role") or ""
            kind = "meta" if role in META_ROLES else "user_request" if role == "user" else "assistant_text"
            yield _spoken(kind, plain_text(payload.get("content")))
        case "reasoning":
            if text := plain_text(payload.get("summary")):
                yield _spoken("thinking", text)
        case "custom_tool_call" | "function_call":
            given = payload.get("input")
            given = payload.get("arguments") if given is None else given
            if isinstance(given, str):
                try:
                    target = target_of(json.loads(given))
                except ValueError:
                    target = given.strip()[:400]
                body = given
            else:
                target, body = target_of(given), json.dumps(given, ensure_ascii=False)
            yield _call(payload.get("name"), payload.get("call_id"), target, body)
        case "custom_tool_call_output" | "function_call_output":
            yield _result(payload.get("call_id"), payload.get("output"), False)


def _line(source: str, raw: str) -> Iterator[dict]:
    """First the record itself (role "record"), then its turns."""
    rec = _load(raw)
    if rec is None:
        yield {"role": "record", "note": "bad_json"}
        return
    head = {"role": "record", "ts": seconds(rec.get("timestamp"))}
    turns: Iterator[dict] = iter(())
    if source == "claude_prompts":
        head |= {"sid": _text(rec.get("sessionId")), "cwd": _text(rec.get("project"))}
        turns = iter([_spoken("user_request", rec.get("display"))])
    elif source == "claude_code":
        kind = rec.get("type")
        head |= {"sid": _text(rec.get("sessionId")), "cwd": _text(rec.get("cwd"))}
        if kind == "ai-title" and rec.get("aiTitle"):
            head["title"] = str(rec["aiTitle"])[:200]
        elif kind == "attachment":
            head["note"] = "attachment"
        elif kind in ("user", "assistant", "system"):
            side = bool(rec.get("isSidechain"))
            turns = ({**t, "side": side} for t in _blocks(rec))
    elif isinstance(payload := rec.get("payload"), dict):
        if rec.get("type") == "session_meta":
            head |= {"sid": _text(payload.get("session_id")), "cwd": _text(payload.get("cwd"))}
        elif rec.get("type") == "response_item":
            if payload.get("type") == "reasoning" and payload.get("encrypted_content"):
                head["note"] = "encrypted"
            turns = _items(payload)
    yield head
    for t in turns:
        yield {**t, "ts": head["ts"], "sid": head.get("sid") if source == "claude_prompts" else None}


def emissions(lines: DataFrame) -> DataFrame:
    """SRC6-SRC8: what each line says, without its neighbours.  A line whose parsing fails
    in an unforeseen way becomes a record with the note "failed" (SRC9).

    lines: source, path, raw and either line_no or start and at, which ``numbered`` turns
    into line numbers.  Where a stream has start alone, ``at`` counts the lines of the task:
    a split is read by one task, in order.  A blank line leaves a row with the role "blank",
    to be counted.
    """

    def run(batches):
        seen = 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw = row.pop("raw")
                if row["line_no"] is None and row["at"] is None:
                    row["at"] = seen
                seen += 1
                try:
                    found = list(_line(row["source"], raw)) if raw else [{"role": "blank"}]
                except Exception:  # noqa: BLE001  one odd line must not end the job
                    found = [{"role": "record", "note": "failed"}]
                out += [{**row, "pos": k, **f} for k, f in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    placed = [F.col(c) if c in lines.columns else F.lit(None).cast(COLUMNS[c]).alias(c) for c in ("line_no", "start", "at")]
    return lines.select("source", "path", *placed, "raw").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in COLUMNS.items()))


def numbered(emitted: DataFrame, path: str | None = None) -> DataFrame:
    """Written emissions of split files with their line numbers, without blank lines."""
    splits = put(line_splits(emitted), "splits", path)
    return number_lines(emitted.filter("role <> 'blank'").drop("line_no"), splits).select(*COLUMNS)


def _clean(said: DataFrame, most: int) -> DataFrame:
    """PRJ3, PRJ7, PRJ8, JON3: clipped text and final kind of each turn, empties included.
    Only a call's and a result's names and places are looked at for the tool of a result."""
    result = F.col("role") == "result"
    calls = said.filter("role in ('tool_input', 'result')").select("path", "line_no", "pos", "call", "role", "tool")
    named = latest(calls, ["path", "call"], F.when(F.col("role") == "tool_input", F.col("tool")), "named").filter(result).select("path", "line_no", "pos", "named")
    results = said.filter(result).join(named, ["path", "line_no", "pos"]).withColumn("tool", F.col("named"))
    said = said.filter(~result).unionByName(results.drop("named"))
    kind = F.when(result, result_kind(F.col("body"), F.coalesce("flagged", F.lit(False)))).otherwise(F.col("role"))
    out = said.withColumn("tool", F.coalesce("tool", F.lit(""))).withColumn("kind", kind).withColumn("c", clip(F.coalesce("body", F.lit("")), most))
    return out.select("source", "path", "line_no", "pos", "ts", "sid", "kind", "tool", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("side", F.lit(False)).alias("sidechain"), "c.*")


def _stem(path: str = "path"):
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def build(emitted: DataFrame, home: str = "/nonexistent", most: int = MAX_TEXT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns, sessions and parse counters of emissions of any mix of sources (SET1).

    emitted is used several times: write or cache it before.  What was said and the turns
    are written on the way (``work.clear`` removes them), since all that follows reads them.
    """
    said = put(_clean(emitted.filter("role <> 'record'"), most), "said")
    records = emitted.filter("role = 'record'")
    files = emitted.filter("source <> 'claude_prompts'")
    set_ = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.struct("line_no", F.col(c).alias("v")))
    dated = F.when(F.col("ts") > 0, F.col("ts"))
    # AGG7, WIN3: one row a file
    values = files.filter("role = 'record'").groupBy("source", "path").agg(F.max(set_("sid"))["v"].alias("sid"), F.max(set_("cwd"))["v"].alias("cwd"), F.max(set_("title"))["v"].alias("title"), F.min(dated).alias("first_ts"), F.max(dated).alias("last_ts"))
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    project = F.when(F.col("cwd").isNotNull(), collapse_home(F.col("cwd"), home)).when(F.col("source") == "claude_code", decode_project_dir(folder, home)).otherwise("")
    by_file = values.select("source", "path", F.coalesce("sid", _stem()).alias("session_id"), project.alias("project"), F.coalesce("title", F.lit("")).alias("title"), "first_ts", "last_ts")
    turns = running_number(said.filter("source <> 'claude_prompts' and text <> ''"), ["path"]).join(by_file.select("path", "session_id"), "path")

    # prompt history: sessions by id, without those of which a first-dialect file has turns
    covered = turns.filter("source = 'claude_code'").select(F.col("session_id").alias("sid")).distinct()
    prompts = said.filter("source = 'claude_prompts' and sid <> ''").join(covered, "sid", "left_anti")
    prompts = running_number(prompts, ["path", "sid"]).withColumn("session_id", F.col("sid"))
    heads = records.filter("source = 'claude_prompts' and sid <> ''").groupBy("source", "path", F.col("sid").alias("session_id")).agg(F.min_by("cwd", "line_no").alias("cwd"), F.min(dated).alias("first_ts"), F.max(dated).alias("last_ts"))
    by_prompt = heads.select("source", "path", "session_id", collapse_home(F.coalesce("cwd", F.lit("")), home).alias("project"), F.lit("").alias("title"), "first_ts", "last_ts")

    turns = put(turns.drop("sid").unionByName(prompts.filter("text <> ''").drop("sid")), "placed")
    held = turns.groupBy("source", "path", "session_id").agg(F.count(F.lit(1)).cast("int").alias("turns"))
    key = F.xxhash64("source", "session_id", "path")
    sessions = by_file.unionByName(by_prompt).join(held, ["source", "path", "session_id"])
    sessions = sessions.select(key.alias("session_key"), "session_id", "source", "project", "path", "title", F.coalesce("first_ts", F.lit(0.0)).alias("first_ts"), F.coalesce("last_ts", F.lit(0.0)).alias("last_ts"), "turns")
    # the key of a turn is its place, so it does not depend on how the job was cut
    turns = turns.select(F.xxhash64("source", "path", "line_no", "pos").alias("turn_id"), key.alias("session_key"), F.col("seq").cast("int").alias("seq"), "ts", "kind", "tool", "target", "text", "sidechain", "truncated", F.col("orig_len").cast("int").alias("orig_len"), fold_column(F.col("text")).alias("text_tok"), fold_column(F.col("target")).alias("target_tok"))
    turns = put(turns, "turns")
    return turns, sessions, counters(records, said, turns)


def counters(records: DataFrame, said: DataFrame, turns: DataFrame) -> DataFrame:
    """AGG8: name, n.  Sums over rows, so retried tasks never count twice."""
    notes = records.select(F.coalesce("note", F.lit("")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("name <> ''")
    total = records.agg(F.lit("records").alias("name"), F.count(F.lit(1)).alias("n"))
    empty = said.filter("text = ''").agg(F.lit("skipped_empty").alias("name"), F.count(F.lit(1)).alias("n"))
    kinds = turns.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("kind_"), "kind").alias("name"), "n")
    files = records.agg(F.lit("files").alias("name"), F.countDistinct("path").alias("n"))
    return total.unionByName(files).unionByName(notes).unionByName(empty).unionByName(kinds)
