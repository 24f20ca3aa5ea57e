"""Adapters: general tables in the shape of turns joined with sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens_sql

DAY = 86_400
BASE_TS = 1_700_000_000
_ROLE = {"user": "user_request", "assistant": "assistant_text", "system": "meta"}
_EVENT = {"error": "error", "signup": "user_request", "purchase": "assistant_text", "click": "tool_input", "view": "tool_output"}


def _case(c: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _shape(df: DataFrame, **cols: Column) -> DataFrame:
    plain = {"tool": F.lit(""), "target": F.lit(""), "text": F.lit(""), "project": F.lit(""), "sidechain": F.lit(False), "ts": F.lit(0.0)} | cols
    out = df.select(*[c.alias(k) for k, c in plain.items()])
    return out.withColumn("session_key", F.xxhash64("source", "session_id")).withColumn("text_tok", tokens_sql(F.col("text"))).withColumn("target_tok", tokens_sql(F.col("target")))


def conversations_to_turns(df: DataFrame, dated: bool = False) -> DataFrame:
    """Session conv_id, seq turn, kind by role.  dated: a day a conversation, a minute a turn."""
    ts = (F.lit(BASE_TS) + F.col("conv_id") * DAY + F.col("turn") * 60).cast("double") if dated else F.lit(0.0)
    return _shape(df, source=F.lit("conversations"), session_id=F.col("conv_id").cast("string"), seq=F.col("turn").cast("int"), turn_id=F.col("conv_id") * 10_000 + F.col("turn"), kind=_case(F.col("role"), _ROLE, "meta"), text=F.coalesce("text", F.lit("")), ts=ts)


def events_to_turns(df: DataFrame) -> DataFrame:
    """Session user_id, seq by time, kind by event type, target props."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = df.withColumn("_seq", F.row_number().over(w) - 1)
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return _shape(df, source=F.lit("events"), session_id=F.col("user_id").cast("string"), seq=F.col("_seq").cast("int"), turn_id=F.col("event_id"), kind=_case(F.col("event_type"), _EVENT, "meta"), tool=F.col("event_type"), target=F.coalesce("props", F.lit("")), text=F.col("event_type"), ts=ts)


def documents_to_turns(df: DataFrame) -> DataFrame:
    """One turn a document; project is its source, tool its language."""
    return _shape(df, source=F.lit("documents"), session_id=F.col("doc_id").cast("string"), seq=F.lit(0), turn_id=F.col("doc_id"), kind=F.lit("tool_output"), tool=F.coalesce("lang", F.lit("")), project=F.coalesce("source", F.lit("")), text=F.coalesce("text", F.lit("")))


def conversations_to_transcripts(df: DataFrame) -> DataFrame:
    """Conversations written out as transcript lines (source, path, line_no, raw), in all
    dialects, for the parser to read: by conv_id modulo 3 a prompt history alone (0), a
    file of the first dialect (1) or of the second (2).  Each assistant turn calls a tool,
    each later user turn brings the result of the call of that id; every user turn is in
    the prompt history too.
    """
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    call, tool, command = F.concat(F.lit("c"), F.floor(turn % 4 / 2)), F.concat(F.lit("T"), turn % 5), F.concat(F.lit("run "), turn)
    sid, cwd = F.concat(F.lit("s"), conv), F.concat(F.lit("/home/al/p"), conv % 7)
    ts, outcome = F.lit(BASE_TS) + conv * DAY + turn * 60, F.concat(F.lit("exit code "), turn % 3)
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    iso = F.concat(F.date_format(F.timestamp_seconds(ts).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    args = F.struct(command.alias("command"))
    s = lambda **k: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in k.items()])
    raw = lambda rec: F.to_json(rec)

    block = F.when(user & (turn > 0), raw(s(type="tool_result", tool_use_id=call, content=outcome))).when(assistant, raw(s(type="tool_use", id=call, name=tool, input=args)))
    said = F.when(text.isNotNull(), raw(s(type="text", text=text)))
    content = F.concat(F.lit("["), F.concat_ws(",", said, block), F.lit("]"))
    head = s(type=F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("system"), timestamp=iso, sessionId=sid, cwd=cwd, isSidechain=turn % 4 == 1)
    plain = F.when(F.col("role").isin("user", "assistant"), F.lit(None)).otherwise(text)
    first = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.when(plain.isNotNull(), F.concat(F.lit(',"content":'), raw(s(t=plain)).substr(F.lit(6), F.length(raw(s(t=plain))) - 6))).otherwise(F.concat(F.lit(',"message":{"content":'), content, F.lit("}"))), F.lit("}"))
    one = df.filter(conv % 3 == 1).withColumn("h", raw(head))
    lines = [one.select(F.lit("claude_code").alias("source"), F.concat(F.lit("/x/claude/-home-al-q/"), conv, F.lit(".jsonl")).alias("path"), turn.cast("int").alias("line_no"), first.alias("raw"))]
    names = one.select("conv_id").distinct()
    lines.append(names.select(F.lit("claude_code"), F.concat(F.lit("/x/claude/-home-al-q/"), conv, F.lit(".jsonl")), F.lit(1_000_000), raw(s(type="ai-title", aiTitle=F.concat(F.lit("Talk "), conv)))))

    two, at = df.filter(conv % 3 == 2), F.concat(F.lit("/x/codex/"), conv, F.lit(".jsonl"))
    item = lambda n, payload, where: two.filter(where).select(F.lit("codex"), at, (turn * 2 + n).cast("int"), raw(s(type="response_item", timestamp=ts, payload=payload)))
    lines.append(two.select("conv_id").distinct().select(F.lit("codex"), at, F.lit(0), raw(s(type="session_meta", payload=s(session_id=sid, cwd=cwd)))))
    lines.append(item(1, s(type="message", role=F.col("role"), content=F.array(s(type="input_text", text=text))), F.lit(True)))
    lines.append(item(2, s(type="function_call", call_id=call, name=tool, arguments=raw(args)), assistant))
    lines.append(item(2, s(type="function_call_output", call_id=call, output=outcome), user & (turn > 0)))

    lines.append(df.filter(user).select(F.lit("claude_prompts"), F.lit("/x/history.jsonl"), (conv * 1000 + turn).cast("int"), raw(s(display=text, timestamp=ts * 1000, sessionId=sid, project=cwd))))
    out = lines[0]
    for part in lines[1:]:
        out = out.unionAll(part)
    return out
