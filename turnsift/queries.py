"""The registered queries of the search engine and their DuckDB SQL.

Ages are counted from the literal NOW; results are cast to fixed types and doubles are
rounded, so that both sides state the same values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import detect
from .functions import excerpt, redact, score, text
from .operators import context, page, postings, search, stats
from .operators.filters import Filters
from .plans import export, measure
from .sources import parse, tables, work

NOW = float(tables.BASE_TS + 60 * tables.DAY)
EVENTS_NOW = 1_706_918_400.0  # 2024-02-03


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _conv(spark, sf):
    return tables.conversations_to_turns(_read(spark, sf, "conversations"), dated=True)


def _docs(spark, sf):
    return tables.documents_to_turns(_read(spark, sf, "documents"))


def _events(spark, sf):
    return tables.events_to_turns(_read(spark, sf, "events"))


TOK = "coalesce(' ' || nullif(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' '), '') || ' ', '')"
CONV = f"""WITH t AS (SELECT *, {TOK} AS tok FROM (SELECT conv_id * 10000 + turn AS turn_id, CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS seq,
 CASE role WHEN 'user' THEN 'user_request' WHEN 'assistant' THEN 'assistant_text' ELSE 'meta' END AS kind, coalesce(text, '') AS text,
 CAST({tables.BASE_TS} + conv_id * 86400 + turn * 60 AS DOUBLE) AS ts FROM conversations))"""
DOCS = f"WITH t AS (SELECT *, {TOK} AS tok FROM (SELECT doc_id AS turn_id, CAST(doc_id AS VARCHAR) AS session_id, coalesce(lang, '') AS tool, coalesce(source, '') AS project, coalesce(text, '') AS text FROM documents))"
EVENTS = """WITH t AS (SELECT event_id AS turn_id, CAST(user_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'user_request' WHEN 'purchase' THEN 'assistant_text' WHEN 'click' THEN 'tool_input' WHEN 'view' THEN 'tool_output' ELSE 'meta' END AS kind,
 event_type AS tool, coalesce(props, '') AS target, epoch_us(ts) / 1e6 AS ts FROM events)"""
KIND_SQL = "CASE kind WHEN 'user_request' THEN 5 WHEN 'error' THEN 4 WHEN 'assistant_text' THEN 3 WHEN 'tool_input' THEN 2 WHEN 'tool_output' THEN 1 WHEN 'thinking' THEN 1 ELSE 0 END"


def _recency_sql(now: float) -> str:
    age = f"greatest(0.0, ({now} - ts) / 86400.0)"
    return f"CASE WHEN ts <= 0 THEN 0 WHEN {age} <= 7 THEN 3 WHEN {age} <= 30 THEN 2 WHEN {age} <= 180 THEN 1 ELSE 0 END"


def _near_sql(a: str, b: str) -> str:
    places = lambda t: f"list_filter(range(1, length(hay) + 1), lambda i: substring(hay, CAST(i AS BIGINT), {len(t)}) = '{t}')"
    return f"len(list_filter({places(a)}, lambda p: len(list_filter({places(b)}, lambda q: greatest(p + {len(a)}, q + {len(b)}) - least(p, q) <= 60)) > 0)) > 0"


def _scored_sql(a: str, b: str) -> str:
    hit = f"contains(tok, ' {a} ') AND contains(tok, ' {b} ') AND kind <> 'meta'"
    return f"""{CONV}, f AS (SELECT *, lower(text || chr(10)) AS hay FROM t WHERE {hit}),
 p AS (SELECT *, {KIND_SQL} AS kind_pts, 2 * (CAST(contains(hay, '{a}') AS INTEGER) + CAST(contains(hay, '{b}') AS INTEGER)) AS terms_pts, CASE WHEN {_near_sql(a, b)} THEN 3 ELSE 0 END AS phrase_pts, {_recency_sql(NOW)} AS recency_pts FROM f),
 s AS (SELECT *, kind_pts + terms_pts + phrase_pts + recency_pts AS score FROM p)"""


SCORE = ["turn_id", "session_id", "seq", "kind", "kind_pts", "terms_pts", "phrase_pts", "recency_pts", "score"]
QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _scored(spark, sf, terms, **filters):
    found = search.candidates(_conv(spark, sf), terms, Filters(**filters), folded=False)
    return search.score(found, terms, NOW)


@register(f"{_scored_sql('the', 'and')} SELECT {', '.join(SCORE)} FROM s ORDER BY score DESC, ts DESC, session_id, seq, turn_id LIMIT 10")
def search_terms_topk(spark, sf):
    return search.top_turns(_scored(spark, sf, ["the", "and"]), 10).select(SCORE)


def _term_index(spark, turns) -> postings.Index:
    return postings.write(turns, work.folder(spark, "terms"), tokens=text.tokens_sql)


@register(ORACLE["search_terms_topk"])
def search_index_topk(spark, sf):
    # by way of a term index, with an early stop
    return postings.top(_term_index(spark, _conv(spark, sf)), None, ["the", "and"], NOW, 10, folded=False)[0].select(SCORE)


@register(f"{DOCS} SELECT turn_id, tool, project FROM t WHERE contains(tok, ' of the ') AND contains(tok, ' license ')")
def search_index_phrase(spark, sf):
    found = postings.candidates(_term_index(spark, _docs(spark, sf)), None, ["of the", "License"], folded=False)
    return found.select("turn_id", "tool", "project")


@register(f"{_scored_sql('the', 'and')} SELECT {', '.join(SCORE)} FROM s")
def score_breakdown(spark, sf):
    return _scored(spark, sf, ["the", "and"]).select(SCORE)


@register(f"{_scored_sql('de', 'la')} SELECT turn_id, phrase_pts FROM s")
def phrase_bonus(spark, sf):
    return _scored(spark, sf, ["de", "la"]).select("turn_id", "phrase_pts")


def _three_sql(a: str, b: str, c: str) -> str:
    """The window rule for three terms: from each place of the rarest, the first place of
    the next term that keeps the span, then any place of the last that does."""
    at = lambda t: f"list_filter(range(1, length(hay) + 1), lambda i: substring(hay, CAST(i AS BIGINT), {len(t)}) = '{t}')"

    def near(p, q, r):
        (x, m), (y, n), (z, o) = p, q, r
        first = f"list_filter({y}, lambda j: greatest(i + {m}, j + {n}) - least(i, j) <= 60)[1:1]"
        last = f"len(list_filter({z}, lambda k: greatest(i + {m}, j + {n}, k + {o}) - least(i, j, k) <= 60)) > 0"
        return f"len(list_filter({x}, lambda i: len(list_filter({first}, lambda j: {last})) > 0)) > 0"

    t = [("pa", len(a)), ("pb", len(b)), ("pc", len(c))]
    rare = f"CASE WHEN len(pa) <= len(pb) AND len(pa) <= len(pc) THEN {near(t[0], t[1], t[2])} WHEN len(pb) <= len(pc) THEN {near(t[1], t[0], t[2])} ELSE {near(t[2], t[0], t[1])} END"
    hit = " AND ".join(f"contains(tok, ' {x} ')" for x in (a, b, c))
    return f"{CONV}, f AS (SELECT *, lower(text || chr(10)) AS hay FROM t WHERE {hit} AND kind <> 'meta'), g AS (SELECT *, {at(a)} AS pa, {at(b)} AS pb, {at(c)} AS pc FROM f) SELECT turn_id, CASE WHEN {rare} THEN 3 ELSE 0 END AS phrase_pts FROM g"


@register(_three_sql("the", "and", "of"))
def phrase_bonus_three_terms(spark, sf):
    return _scored(spark, sf, ["the", "and", "of"]).select("turn_id", "phrase_pts")


@register(f"""{_scored_sql("the", "thin")}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ts DESC, seq, turn_id) AS n, count(*) OVER (PARTITION BY session_id) AS hits FROM s)
 SELECT session_id, CAST(hits AS BIGINT) AS hits, score AS best, CAST(least(5, hits - 1) AS INTEGER) AS extra, CAST(score + least(5, hits - 1) AS INTEGER) AS score, turn_id FROM r WHERE n = 1""")
def sessions_ranked(spark, sf):
    return search.rank_sessions(_scored(spark, sf, ["the", "thin"])).select("session_id", "hits", "best", "extra", "score", "turn_id")


@register(f"""{_scored_sql("the", "thin")}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, ts DESC, seq, turn_id) AS n, count(*) OVER (PARTITION BY session_id) AS hits FROM s),
 b AS (SELECT session_id, CAST(score + least(5, hits - 1) AS INTEGER) AS score, hits, ts AS last_ts, text FROM r WHERE n = 1) SELECT session_id, score, CAST(hits AS BIGINT) AS hits, text FROM b ORDER BY score DESC, last_ts DESC, session_id LIMIT 7""")
def sessions_top(spark, sf):
    found = _scored(spark, sf, ["the", "thin"])
    ranked = search.rank_sessions(found).withColumn("last_ts", F.col("ts"))
    return search.with_texts(search.top_sessions(ranked, 7), found, 7).select("session_id", "score", "hits", "text")


@register("SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS tok FROM documents) WHERE contains(tok, ' cion ') OR contains(tok, ' que la ')")
def search_folded(spark, sf):
    docs = _docs(spark, sf).withColumn("text_tok", text.fold_column(F.col("text")))
    either = text.matches(["Ción"]) | text.matches(["qué la"])
    return docs.filter(either).select(F.col("turn_id").alias("doc_id"))


SCRIPTS = ["Ωμέγα και ΣΟΦΌΣ", "Ёлка, чай й", "Việt Nam", "ÅNGSTRÖM İstanbul", "plain words"]
_SCRIPTS = "(SELECT doc_id, s || chr(10) || coalesce(text, '') AS text FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SCRIPTS)) + f") v(k, s) ON k = doc_id % {len(SCRIPTS)})"


@register(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS tok FROM {_SCRIPTS}) WHERE contains(tok, ' ωμεγα ') OR contains(tok, ' елка чаи ') OR contains(tok, ' viet nam ') OR contains(tok, ' angstrom ')")
def search_folded_scripts(spark, sf):
    # each document behind a few words of a script, by its number
    words = F.element_at(F.array(*[F.lit(s) for s in SCRIPTS]), F.pmod("doc_id", F.lit(len(SCRIPTS))).cast("int") + 1)
    docs = _read(spark, sf, "documents").select("doc_id", F.concat(words, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    docs = docs.select("doc_id", text.fold_column(F.col("text")).alias("text_tok"), F.lit("").alias("target_tok"))
    any_of = text.matches(["ΩΜΕΓΑ"]) | text.matches(["ёлка ЧАЙ"]) | text.matches(["VIET Nam"]) | text.matches(["Angström"])
    return docs.filter(any_of).select("doc_id")


@register(f"{DOCS} SELECT turn_id, tool, project FROM t WHERE contains(tok, ' of the ')")
def search_phrase_term(spark, sf):
    return search.candidates(_docs(spark, sf), ["of the"], folded=False).select("turn_id", "tool", "project")


@register(f"{CONV} SELECT turn_id FROM t WHERE false")
def search_no_match(spark, sf):
    return search.candidates(_conv(spark, sf), ["the", "--"], folded=False).select("turn_id")


@register(f"{CONV} SELECT turn_id, kind FROM t WHERE kind IN ('user_request', 'meta')")
def filter_kind_in(spark, sf):
    return search.candidates(_conv(spark, sf), [], Filters(kind=["user_request", "meta"])).select("turn_id", "kind")


@register(f"{CONV} SELECT turn_id, kind FROM t WHERE kind <> 'meta'")
def filter_meta_default(spark, sf):
    return search.candidates(_conv(spark, sf), []).select("turn_id", "kind")


@register(f"{CONV} SELECT turn_id, kind FROM t")
def filter_include_meta(spark, sf):
    return search.candidates(_conv(spark, sf), [], Filters(include_meta=True)).select("turn_id", "kind")


@register(f"{EVENTS} SELECT turn_id, tool FROM t WHERE lower(tool) IN ('click', 'error') AND kind <> 'meta'")
def filter_tool_ci(spark, sf):
    return search.candidates(_events(spark, sf), [], Filters(tool=["CLICK", "Error"])).select("turn_id", "tool")


@register(f"{DOCS} SELECT turn_id, project FROM t WHERE project ILIKE '%RC_%'")
def filter_project_like(spark, sf):
    return search.candidates(_docs(spark, sf), [], Filters(project="RC_")).select("turn_id", "project")


@register(f"{CONV} SELECT turn_id, session_id FROM t WHERE session_id LIKE '1%' AND kind <> 'meta'")
def filter_session_prefix(spark, sf):
    return search.candidates(_conv(spark, sf), [], Filters(session="1")).select("turn_id", "session_id")


@register("SELECT 'conversations' AS source, count(*) AS n FROM conversations")
def filter_source_in(spark, sf):
    both = _conv(spark, sf).unionByName(_docs(spark, sf))
    return search.candidates(both, [], Filters(source=["conversations"], include_meta=True)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register(f"{EVENTS} SELECT turn_id, ts FROM t WHERE ts >= 1705276800 AND ts <= 1705881600 AND kind <> 'meta'")
def filter_since_until(spark, sf):
    return search.candidates(_events(spark, sf), [], Filters(since=1705276800.0, until=1705881600.0)).select("turn_id", "ts")


@register(f"{CONV} SELECT turn_id FROM t WHERE kind <> 'meta' ORDER BY turn_id LIMIT 100")
def filter_scan_cap(spark, sf):
    return search.candidates(_conv(spark, sf), [], scan=100).select("turn_id")


@register(f"{EVENTS} SELECT turn_id, {KIND_SQL} AS kind_pts FROM t")
def kind_points(spark, sf):
    return _events(spark, sf).select("turn_id", score.kind_points(F.col("kind")).alias("kind_pts"))


@register(f"{EVENTS} SELECT turn_id, {_recency_sql(EVENTS_NOW)} AS recency_pts FROM t")
def recency_bands(spark, sf):
    return _events(spark, sf).select("turn_id", score.recency_points(F.col("ts"), EVENTS_NOW).alias("recency_pts"))


@register(f"{DOCS} SELECT turn_id, 2 * (CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER)) AS terms_pts FROM t")
def terms_points(spark, sf):
    hay = score.haystack(F.col("text"), F.col("target"))
    return _docs(spark, sf).select("turn_id", score.terms_points(hay, ["The", "license", "The"]).alias("terms_pts"))


@register(f"""{CONV}, h AS (SELECT * FROM t WHERE contains(tok, ' thin ')) SELECT h.turn_id AS hit_id, t.seq, CAST(t.seq - h.seq AS INTEGER) AS "offset", t.kind FROM h JOIN t ON t.session_id = h.session_id AND t.seq BETWEEN h.seq - 1 AND h.seq + 1""")
def neighbours_range(spark, sf):
    turns = _conv(spark, sf)
    hits = search.candidates(turns, ["thin"], Filters(include_meta=True), folded=False)
    return context.neighbours(hits, turns).select("hit_id", "seq", "offset", "kind")


@register(f"""{CONV}, s AS (SELECT session_id, max(ts) AS last_ts FROM t GROUP BY 1), o AS (SELECT session_id FROM s WHERE session_id LIKE '2%' ORDER BY last_ts DESC, session_id LIMIT 1) SELECT session_id, seq, kind FROM t JOIN o USING (session_id) WHERE seq BETWEEN 0 AND 4""")
def show_window(spark, sf):
    turns = _conv(spark, sf)
    sessions = turns.groupBy("session_key", "session_id", "source").agg(F.max("ts").alias("last_ts")).withColumn("path", F.lit(""))
    return context.show_window(turns.drop("session_id"), sessions, "2", seq=1, span=3).join(sessions, "session_key").select("session_id", "seq", "kind")


@register(f"{EVENTS} SELECT kind, count(*) AS n FROM t GROUP BY 1")
def stats_by_kind(spark, sf):
    return stats.by_kind(_events(spark, sf)).withColumnRenamed("count", "n")


@register("SELECT event_type AS tool, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1 ORDER BY n DESC, tool LIMIT 20")
def stats_top_tools(spark, sf):
    return stats.top_tools(_events(spark, sf)).withColumnRenamed("count", "n")


def _sessions(turns):
    return turns.groupBy("source", "session_id").agg(F.first("project").alias("project"), F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("first_ts"), F.max("ts").alias("last_ts"))


@register("""SELECT count(*) AS sessions, count(DISTINCT project) AS projects, sum(n) AS turns FROM (SELECT doc_id, any_value(coalesce(source, '')) AS project, count(*) AS n FROM documents GROUP BY 1)""".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def stats_distinct_projects(spark, sf):
    turns = _docs(spark, sf)
    return stats.totals(turns, _sessions(turns)).select("sessions", "projects", "turns")


@register(f"{EVENTS} SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM t")
def stats_span(spark, sf):
    turns = _events(spark, sf)
    return stats.totals(turns, _sessions(turns)).select("first_ts", "last_ts")


@register("SELECT 'conversations' AS source, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM documents")
def stats_by_source(spark, sf):
    both = _conv(spark, sf).unionByName(_docs(spark, sf))
    return stats.by_source(_sessions(both)).withColumnRenamed("count", "n")


HOME = "/home/al"
# The transcripts of sources.tables as the parser must read them: each said thing (v: by
# its place), results with the tool of the latest call of that id before them.
SAID = f"""WITH c AS (SELECT conv_id AS k, turn, role, text, CAST({tables.BASE_TS} + conv_id * 86400 + turn * 60 AS DOUBLE) AS ts, turn % 4 // 2 AS call, conv_id % 3 AS m,
  CASE WHEN role = 'user' THEN 'user_request' WHEN role = 'assistant' THEN 'assistant_text' ELSE 'meta' END AS spoken FROM conversations),
 v AS (SELECT k, m, turn, 1 AS pos, ts, spoken AS kind, '' AS tool, '' AS target, text AS body FROM c WHERE m > 0
  UNION ALL SELECT k, m, turn, 2, ts, 'tool_input', 'T' || turn % 5, 'run ' || turn, 'T' || turn % 5 || CASE m WHEN 1 THEN ' {{"command": "run ' ELSE ' {{"command":"run ' END || turn || '"}}' FROM c WHERE m > 0 AND role = 'assistant'
  UNION ALL SELECT k, m, turn, 2, ts, CASE WHEN turn % 3 > 0 THEN 'error' ELSE 'tool_output' END, coalesce((SELECT 'T' || max(a.turn) % 5 FROM c a WHERE a.k = c.k AND a.role = 'assistant' AND a.call = c.call AND a.turn < c.turn), ''), '', 'exit code ' || turn % 3 FROM c WHERE m > 0 AND role = 'user' AND turn > 0
  UNION ALL SELECT k, 3, turn, 1, ts, 'user_request', '', '', text FROM c WHERE role = 'user'),
 w AS (SELECT *, regexp_replace(replace(coalesce(body, ''), chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS t FROM v),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY k, m, m = 3 OR t <> '' ORDER BY turn, pos) - 1 AS INTEGER) AS seq, CASE m WHEN 1 THEN 'claude_code' WHEN 2 THEN 'codex' ELSE 'claude_prompts' END AS source FROM w),
 kept AS (SELECT *, 's' || k AS session_id FROM n WHERE t <> '' AND (m < 3 OR k % 3 <> 1))"""


def _ingested(spark, sf):
    """Emissions of the transcripts, written, since their tables are built from several looks."""
    return work.put(parse.emissions(tables.conversations_to_transcripts(_read(spark, sf, "conversations"))), "emissions")


def _built(spark, sf):
    return parse.build(_ingested(spark, sf), home=HOME)


@register(f"{SAID} SELECT source, session_id, seq, kind, tool, target, substring(t, 1, 20000) AS text, ts, m = 1 AND turn % 4 = 1 AS sidechain FROM kept")
def ingest_turns(spark, sf):
    turns, sessions, _ = _built(spark, sf)
    return search.with_sessions(turns, sessions).select("source", "session_id", "seq", "kind", "tool", "target", "text", "ts", "sidechain")


@register(f"{SAID} SELECT source, session_id, seq, tool, kind FROM kept WHERE pos = 2 AND kind <> 'tool_input'")
def tool_name_asof(spark, sf):
    turns, sessions, _ = _built(spark, sf)
    return search.with_sessions(turns, sessions).filter("kind in ('error', 'tool_output')").select("source", "session_id", "seq", "tool", "kind")


@register(f"{SAID} SELECT session_id, seq, kind FROM kept WHERE m < 3")
def seq_dense(spark, sf):
    turns, sessions, _ = _built(spark, sf)
    return search.with_sessions(turns, sessions).filter("source <> 'claude_prompts'").select("session_id", "seq", "kind")


@register(f"{SAID} SELECT session_id, seq, ts FROM kept WHERE m = 3")
def seq_gappy(spark, sf):
    turns, sessions, _ = _built(spark, sf)
    return search.with_sessions(turns, sessions).filter("source = 'claude_prompts'").select("session_id", "seq", "ts")


@register(f"{SAID} SELECT session_id, count(*) AS n FROM kept WHERE m = 3 GROUP BY 1")
def prompt_recovery_anti(spark, sf):
    # sessions of the prompt history of which no first-dialect file has turns
    turns, sessions, _ = _built(spark, sf)
    found = search.with_sessions(turns, sessions).filter("source = 'claude_prompts'")
    return found.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


SESSIONS = f"""{SAID}, b AS (SELECT k, m, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT k, m, ts FROM c WHERE m > 0 UNION ALL SELECT k, 3, ts FROM c WHERE role = 'user') GROUP BY 1, 2),
 s AS (SELECT source, session_id, any_value('~/p' || k % 7) AS project, any_value(CASE WHEN m = 1 THEN 'Talk ' || k ELSE '' END) AS title, any_value(b.first_ts) AS first_ts, any_value(b.last_ts) AS last_ts, CAST(count(*) AS INTEGER) AS turns FROM kept JOIN b USING (k, m) GROUP BY 1, 2)"""


@register(f"{SESSIONS} SELECT * FROM s")
def session_bounds_last_value(spark, sf):
    return _built(spark, sf)[1].select("source", "session_id", "project", "title", "first_ts", "last_ts", "turns")


@register(f"""{SAID}, r AS (SELECT count(*) + count(*) FILTER (WHERE m = 2 AND (role = 'assistant' OR role = 'user' AND turn > 0)) AS n FROM c WHERE m > 0),
 x AS (SELECT 'records' AS name, r.n + (SELECT count(DISTINCT k) FROM c WHERE m > 0) + (SELECT count(*) FROM c WHERE role = 'user') AS n FROM r
  UNION ALL SELECT 'files', (SELECT count(DISTINCT k) FROM c WHERE m > 0) + (SELECT count(*) FROM (SELECT 1 FROM c WHERE role = 'user' LIMIT 1))
  UNION ALL SELECT 'skipped_empty', count(*) FROM w WHERE t = '' UNION ALL SELECT 'kind_' || kind, count(*) FROM kept GROUP BY 1) SELECT name, CAST(n AS BIGINT) AS n FROM x""")
def ingest_counters(spark, sf):
    return _built(spark, sf)[2]


@register(f"{SAID} SELECT session_id, seq, kind FROM kept WHERE m = 1 AND turn % 4 = 1 AND kind <> 'meta'")
def filter_sidechain(spark, sf):
    turns, sessions, _ = _built(spark, sf)
    return search.candidates(search.with_sessions(turns, sessions), [], Filters(sidechain=True)).select("session_id", "seq", "kind")


SIGNS = ["Traceback (most recent call last)", "x.ValueError: bad", "error[E0308]", "fatal: no", "FAILED tests", "FAILURE", "npm ERR! x", "command not found", "Permission denied", "exit code 3", "exit 0", "all fine: Error"]
SIGNS_SQL = "(VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SIGNS)) + ") v(k, sign)"


@register(f"""SELECT k, doc_id, CASE WHEN regexp_matches(substring(sign || chr(10) || coalesce(text, ''), 1, 400), '(?:^|\\n)\\s*(?:Traceback \\(most recent call last\\)|[A-Za-z_.]*(?:Error|Exception)\\s*:|error\\[E\\d+\\]|fatal:|FAIL(?:ED)?\\b|npm ERR!|command not found|Permission denied|exit (?:code )?[1-9]\\d*)') THEN 'error' ELSE 'tool_output' END AS kind FROM documents, {SIGNS_SQL} WHERE k = doc_id % 12""")
def error_signal_kind(spark, sf):
    # each document gets the sign of its number in front: all rows, both outcomes
    docs = _read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.pmod("doc_id", F.lit(len(SIGNS))).cast("int").alias("k"))
    sign = F.element_at(F.array(*[F.lit(s) for s in SIGNS]), F.col("k") + 1)
    return docs.select("k", "doc_id", text.result_kind(F.concat(sign, F.lit("\n"), F.col("text")), F.lit(False)).alias("kind"))


_EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


@register(f"""SELECT event_id, CASE event_id % 7 WHEN 2 THEN {_EPOCH} + event_id % 1000 / 1000.0 WHEN 4 THEN {_EPOCH} - 7200.0 WHEN 5 THEN epoch(date_trunc('day', ts)) WHEN 6 THEN 0.0 WHEN 0 THEN 0.0 ELSE {_EPOCH} END::DOUBLE AS ts FROM events""")
def epoch_normalise(spark, sf):
    # each event's time in one of the forms that transcripts have, by its number
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = F.floor(t / 1_000_000)
    at = lambda form: F.date_format(F.timestamp_seconds(whole), form)
    forms = [F.lit(""), whole.cast("string"), (whole * 1000 + F.col("event_id") % 1000).cast("string"), at("yyyy-MM-dd'T'HH:mm:ss'Z'"), at("yyyy-MM-dd'T'HH:mm:ss'+02:00'"), at("yyyy-MM-dd"), F.concat(F.lit("junk "), "event_id")]
    stamp = F.element_at(F.array(*forms), F.pmod("event_id", F.lit(7)).cast("int") + 1)
    return _read(spark, sf, "events").select("event_id", text.epoch_seconds(stamp).alias("ts"))


@register("""SELECT doc_id, substring(c, 1, 500) AS text, length(c) > 500 AS truncated, CAST(length(c) AS INTEGER) AS orig_len FROM (SELECT doc_id, regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '^\\s+|\\s+$', '', 'g') AS c FROM documents)""")
def clip_text(spark, sf):
    return _read(spark, sf, "documents").withColumn("c", text.clip(F.coalesce("text", F.lit("")), 500)).select("doc_id", "c.*")


def _fronted_sql(fronts: list[str]) -> str:
    return "(SELECT doc_id, v.front || coalesce(source, '') AS p FROM documents JOIN (VALUES " + ", ".join(f"({k}, '{f}')" for k, f in enumerate(fronts)) + f") v(k, front) ON v.k = doc_id % {len(fronts)})"


def _fronted(spark, sf, fronts):
    """Each document's source behind one of the fronts, by its number."""
    front = F.element_at(F.array(*[F.lit(f) for f in fronts]), F.pmod("doc_id", F.lit(len(fronts))).cast("int") + 1)
    return _read(spark, sf, "documents").select("doc_id", F.concat(front, F.coalesce("source", F.lit(""))).alias("p"))


PATHS = ["/home/al/", "/home/al", "/home/al/x y/", "/home/alice/", "/tmp/", ""]


@register(f"SELECT doc_id, CASE WHEN p = '/home/al' OR starts_with(p, '/home/al/') THEN '~' || substring(p, 9) ELSE p END AS short FROM {_fronted_sql(PATHS)}")
def collapse_home(spark, sf):
    return _fronted(spark, sf, PATHS).select("doc_id", text.collapse_home(F.col("p"), "/home/al").alias("short"))


FOLDERS = ["-home-al-Projects-", "-home-al-", "-tmp-a-", "-home-alice-", "plain-", ""]


@register(f"SELECT doc_id, CASE WHEN starts_with(p, '-') THEN CASE WHEN starts_with(q, '/home/al/') OR q = '/home/al' THEN '~' || substring(q, 9) ELSE q END ELSE p END AS project FROM (SELECT doc_id, p, '/' || replace(substring(p, 2), '-', '/') AS q FROM {_fronted_sql(FOLDERS)})")
def decode_project(spark, sf):
    return _fronted(spark, sf, FOLDERS).select("doc_id", text.decode_project_dir(F.col("p"), "/home/al").alias("project"))


@register("SELECT doc_id, CASE WHEN length(b) > 130 THEN substring(b, 1, 130) || '…' ELSE b END AS line FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS b FROM documents)")
def context_line(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", excerpt.context_line(F.coalesce("text", F.lit(""))).alias("line"))


def _snip_sql(a: str, b: str, inner: str, width: int = 260) -> str:
    """TXT11, TXT12 for two terms: places, the best window, then word boundaries."""
    place = lambda t, p: f"CAST(list_sum(list_transform({p}[1:i], lambda w: length(w))) AS BIGINT) + (i - 1) * {len(t)}"
    at = lambda t, k, p: f"list_transform(range(1, len({p})), lambda i: struct_pack(s := {place(t, p)}, e := {place(t, p)} + {len(t)}, k := {k}))"
    inside = f"list_filter(hits, lambda h: h.s >= x AND h.e <= x + {width})"
    rank = f"list_transform(list_distinct(list_transform(hits, lambda h: h.s)), lambda x: struct_pack(n := -len(list_distinct(list_transform({inside}, lambda h: h.k))), r := coalesce(list_max(list_transform({inside}, lambda h: h.e)), x) - x, s := x))"
    return f"""{inner}, c AS (SELECT turn_id, replace(text, chr(13), '') AS x FROM top), d AS (SELECT turn_id, x AS t, string_split(lower(x), '{a}') AS pa, string_split(lower(x), '{b}') AS pb, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS bare FROM c),
 g AS (SELECT *, list_concat({at(a, 1, "pa")}, {at(b, 2, "pb")}) AS hits FROM d), j AS (SELECT *, greatest(0, coalesce(list_min({rank}).s - {width // 4}, 0)) AS a0 FROM g), k AS (SELECT *, least(length(t), a0 + {width}) AS b0 FROM j),
 l AS (SELECT *, CASE WHEN a0 > 0 AND strpos(substring(t, a0 + 1, least(20, b0 - a0)), ' ') > 0 THEN a0 + strpos(substring(t, a0 + 1, least(20, b0 - a0)), ' ') ELSE a0 END AS a1 FROM k),
 m AS (SELECT *, strpos(reverse(substring(t, greatest(a1, b0 - 20) + 1, b0 - greatest(a1, b0 - 20))), ' ') AS back FROM l), n AS (SELECT *, CASE WHEN b0 < length(t) AND back > 0 AND b0 - back > a1 THEN b0 - back ELSE b0 END AS b1 FROM m)
 SELECT turn_id, CASE WHEN length(t) <= {width} AND NOT contains(bare, chr(10)) THEN bare ELSE CASE WHEN a1 > 0 THEN '…' ELSE '' END || trim(regexp_replace(substring(t, a1 + 1, b1 - a1), '\\s+', ' ', 'g')) || CASE WHEN b1 < length(t) THEN '…' ELSE '' END END AS excerpt FROM n"""


@register(_snip_sql("the", "and", f"{_scored_sql('the', 'and')}, top AS (SELECT turn_id, text FROM s ORDER BY score DESC, ts DESC, session_id, seq, turn_id LIMIT 50)"))
def excerpt_snip(spark, sf):
    hits = search.top_turns(_scored(spark, sf, ["the", "and"]), 50)
    return hits.select("turn_id", excerpt.snip_column(F.col("text"), ["the", "and"]).alias("excerpt"))


@register(_snip_sql("the", "license", "WITH top AS (SELECT doc_id AS turn_id, coalesce(text, '') AS text FROM documents)"))
def excerpt_documents(spark, sf):
    # every whole text, with and without the terms
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("turn_id"), excerpt.snip_column(F.col("text"), ["the", "license"]).alias("excerpt"))


def _lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = "\U0010ffff\U0010fffe"
_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"


def _unicode(p: str) -> str:
    """A pattern whose digit, space and word classes count all of Unicode in RE2, too."""
    out, inside = "", False
    if p.startswith("(?i)"):
        p = p.replace("A-Za-z", r"A-Za-z\x{130}\x{131}")
    for part in re.findall(r"\\.|\(\?[a-z]+\)|.", p, re.S):
        inside = (inside or part == "[") and part != "]"
        if part in ("\\s", "\\w"):
            part = _SPACE if part == "\\s" else _WORD
            part = part if inside else f"[{part}]"
        elif part == "\\S":
            part = f"[^{_SPACE}]"
        elif part == "i" and p.startswith("(?i)") and not inside:
            part = r"[i\x{130}\x{131}]"
        out += "\\p{Nd}" if part == "\\d" else part
    return out


#: What stands twice in a doubled text.  A class with a hyphen before a last word boundary
#: ends with a word's sign before another one, or with a hyphen before a word's sign.
_TWICE = (
    ("[ .\\-]", "(?:  |[.\\-])"), ("\\+?", "(?:\\+\\+)?"), ("\\(?", "(?:\\(\\()?"), ("\\)?", "(?:\\)\\))?"), ("/", "//"),
)
_TWICE_WORDS = (
    ("\\.", "\\.\\."), ("@", "@@"), ("[a-z0-9_.\\-]", "(?:[a-z0-9_]|\\.\\.|--)"), ("[A-Za-z0-9\\-]", "(?:[A-Za-z0-9]|--)"),
    ("[a-z0-9\\-]{2,}", f"(?:[a-z0-9]|--)+(?:--([{_WORD}])|[a-z0-9]"),
)


def _looking(p: str) -> tuple[str, str, str] | None:
    """For a pattern that looks around itself for signs of one class, or for words' ends:
    that class, a pattern that the text must hold, and the pattern over a text in which every other sign stands twice.  It
    takes in one half of a sign on each side, so two matches can share the sign between
    them.  Groups 1, and 2 and on, are what is put back."""
    behind, ahead = re.match(r"\(\?<!\[(.*?)\]\)|\\b", p), re.search(r"\(\?!\[([^\]]*)\]\)$|\\b$", p)
    if not ahead:
        return None
    kept = _unicode(f"[{ahead[1]}]")[1:-1] if ahead[1] else _WORD
    core = bare = p[behind.end() if behind else 0 : ahead.start()]
    first = "/" if core.startswith("/") else ""  # its last half
    core = core.removeprefix(first)
    for one, two in _TWICE if ahead[1] else _TWICE_WORDS:
        core = core.replace(one, two)
    core = _unicode(first + core)
    return kept, _unicode(bare), (f"(^|[^{kept}])" if behind else "()") + core + f"($|[^{kept}])" + ")" * (core.count("(?:--(["))


def _twice_sql(inner: str, kept: str) -> str:
    return f"regexp_replace({inner}, {_lit(f'([^{kept}])')}, '\\1\\1', 'g')"


def _rule_sql(rule, inner: str, exact: bool = False) -> str:
    """A rule in SQL.  RE2 has no look-around: what it looks at is captured and put back.
    Two masks may share such a character, so those rules run twice; ``exact``: they run on a
    text with such characters doubled, since a second run may find what the rule does not."""
    p, into = rule.pattern, rule.into or redact.mask(rule.label)
    p = p.replace(r"(?=/|\b)", r"\b") if exact else p  # a slash ends the word as well
    if exact and (found := _looking(p)):
        kept, bare, wide = found
        if "/" in rule.pattern[:1]:  # two matches can share their first sign: the second run takes the second one
            once = lambda x: f"regexp_replace({x}, {_lit(wide)}, {_lit(into + chr(92) + '2')}, 'g')"
            return once(once(inner))
        doubled = re.sub(r"[^\d.\-]" if "\\-" in kept else r"\W", r"\g<0>\g<0>", into)
        groups = "\\2\\3" if wide.count("(?:--([") else "\\2"
        masked = f"regexp_replace({_twice_sql('x', kept)}, {_lit(wide)}, {_lit(f'{chr(92)}1{doubled}{groups}')}, 'g')"
        single = f"regexp_replace({masked}, {_lit(f'([^{kept}])[^{kept}]')}, '\\1', 'g')"
        return f"list_transform([{inner}], lambda x: CASE WHEN regexp_matches(x, {_lit(bare)}) THEN {single} ELSE x END)[1]"
    if exact and (look := "(?<=bearer )") in p:  # what a match looks at may end the one before: a sign that is no character marks it
        marked = f"regexp_replace({inner}, '(?i)(bearer )', {_lit(f'{chr(92)}1{_MARK}')}, 'g')"
        return f"replace(regexp_replace({marked}, {_lit(_unicode(p.replace(look, _MARK)))}, {_lit(into)}, 'g'), '{_MARK}', '')"
    behind = ahead = ""
    for look, group in ((r"(?<=://)", r"(://)"), (r"(?<=bearer )", r"(bearer )"), (r"(?<![\d.\-])", r"(^|[^\d.\-])"), (r"(?<before>(?<![A-Za-z0-9])", r"((?:^|[^A-Za-z0-9])")):
        if look in p:
            p, behind = p.replace(look, group, 1), "\\1"
    for look, group in ((r"(?=@)", r"(@)"), (r"(?![\d.\-])", r"($|[^\d.\-])"), (r"(?=/|\b)", r"(/|\b)")):
        if p.endswith(look):
            p, ahead = p.removesuffix(look) + group, "\\2" if behind else "\\1"
    p = p.replace("(?![A-Za-z0-9])", "").replace("(?<mask>", "(?:")
    p = _unicode(p) if exact else p
    step = lambda x: f"regexp_replace({x}, {_lit(p)}, {_lit(behind + into + ahead)}, 'g')"
    return step(step(inner)) if behind and ahead else step(inner)


def _rules_sql(label: str | None = None, exact: bool = False) -> str:
    out = "coalesce(text, '')"
    for rule in redact.rules(None):
        if label in (None, rule.label):
            out = _rule_sql(rule, out, exact)
    return out


def _only(spark, sf, label):
    """The rules of one label, gates included, in their order."""
    out = F.coalesce("text", F.lit(""))
    for rule in redact.rules(None):
        if rule.label == label:
            out = redact.bind(out, lambda t, rule=rule: F.when(rule.may_match(t), F.regexp_replace(t, rule.java, rule.replacement)).otherwise(t))
    return _read(spark, sf, "documents").select("doc_id", out.alias("text"))


@register(f"SELECT doc_id, {_rules_sql('address')} AS text FROM documents")
def redact_email(spark, sf):
    return _only(spark, sf, "address")


@register(f"SELECT doc_id, {_rules_sql('high-entropy')} AS text FROM documents")
def redact_hex_run(spark, sf):
    return _only(spark, sf, "high-entropy")


@register(f"SELECT doc_id, {_rules_sql('phone', exact=True)} AS text FROM documents")
def redact_phone(spark, sf):
    return _only(spark, sf, "phone")


@register(f"SELECT doc_id, {_rules_sql('secret-assignment')} AS text FROM documents")
def redact_assignment(spark, sf):
    return _only(spark, sf, "secret-assignment")


def _runs_sql(inner: str, pattern: str, judge: str) -> str:
    """RED36, RED37: each run judged alone.  One gap more than there are runs."""
    cut = f"list_zip(string_split_regex({inner}, {_lit(pattern)}), regexp_extract_all({inner}, {_lit(pattern)}))"
    return f"array_to_string(list_transform({cut}, lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN {judge} THEN '[redacted:high-entropy]' ELSE x[2] END), '')"


_MIXED_SQL = "regexp_matches(x[2], '[0-9]') AND regexp_matches(x[2], '[A-Za-z]')"
_SEGMENTS = "len(list_filter(string_split(x[2], '/'), lambda y: y <> ''))"
_TURNS = "len(list_filter(range(1, length(x[2])), lambda i: regexp_matches(substring(x[2], CAST(i AS BIGINT), 2), '^([a-z][A-Z]|[A-Z][a-z])$')))"
_LETTERS = "len(list_filter(range(1, length(x[2])), lambda i: regexp_matches(substring(x[2], CAST(i AS BIGINT), 2), '^[A-Za-z]{2}$')))"
_BASE64_SQL = f"{_MIXED_SQL} AND ({_SEGMENTS} < 2 OR ({_LETTERS} > 0 AND {_TURNS} >= 0.15 * {_LETTERS}) OR length(replace(x[2], '/', '')) >= {_SEGMENTS} * CASE WHEN starts_with(x[2], '/') THEN 20 ELSE 12 END)"
def _escapes_sql(inner: str) -> str:
    """RED38: every control character by its name or its number."""
    for code in (c for c in range(128) if re.match(redact.CONTROL, chr(c))):
        inner = f"replace({inner}, chr({code}), {_lit(redact.CONTROL_NAMES.get(code, f'{chr(92)}x{code:02x}'))})"
    return inner


def _full_sql(docs: str = "documents", exact: bool = False) -> str:
    """The whole cascade.  d: before and after the home paths; b: before the control bytes."""
    masked = homes = "coalesce(text, '')"
    steps = []
    for rule in redact.rules(None):
        if rule.into:
            steps.append((rule.pattern.replace("(?=/|\\b)", "(?:/|\\b)"), masked))
        masked = _rule_sql(rule, masked, exact)
    counted = " + ".join(f"len(regexp_extract_all({before}, {_lit(p)}))" for p, before in steps)
    return f"""WITH a AS (SELECT doc_id, {counted} AS homes, {masked} AS t FROM {docs}), b AS (SELECT doc_id, homes, {_runs_sql("t", redact.BASE64_RUN, _BASE64_SQL)} AS t FROM a),
 e AS (SELECT doc_id, homes, {_runs_sql("t", redact.MIXED_RUN, _MIXED_SQL)} AS t FROM b), o AS (SELECT doc_id, homes, len(regexp_extract_all(t, {_lit(redact.CONTROL)})) AS controls, {_escapes_sql("t")} AS text FROM e)"""


FULL_SQL = f"{_full_sql(exact=True)} SELECT doc_id, text FROM o"


def _counts_sql(docs: str = "documents") -> str:
    masks = sorted({r.label for r in redact.rules(None) if not r.into})
    each = [f"SELECT '{label}' AS label, len(regexp_extract_all(text, '\\[redacted:{label}\\]')) AS n FROM o" for label in masks]
    each += ["SELECT 'home-path', homes FROM o", "SELECT 'control-byte', controls FROM o"]
    return f"{_full_sql(docs)} SELECT label, CAST(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join(each)}) GROUP BY 1 HAVING sum(n) > 0"


@register(FULL_SQL)
def redact_columns(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", redact.redact_text(F.col("text")).alias("text"))


@register(FULL_SQL)
def redact_full(spark, sf):
    # with the counts computed on the way
    out = _read(spark, sf, "documents").select("doc_id", redact.redact(F.col("text")).alias("r"))
    return out.select("doc_id", "r.text")


@register(_counts_sql())
def redact_counts(spark, sf):
    out = _read(spark, sf, "documents").select(F.explode(redact.redact(F.col("text"))["counts"]).alias("label", "k"))
    return out.groupBy("label").agg(F.sum("k").alias("n"))


def _signs(n: int, signs: str) -> str:
    return "".join(signs[(7 * k + 3) % len(signs)] for k in range(n))


_BODY, _UPPER, _HEX = _signs(40, "bQz7Kd2Wn9Xc4Lr"), _signs(16, "QWERTYUIOP234567"), _signs(32, "0a1b2c3d4e5f")
#: What each rule is for, put together here so that no key stands in the source.
PLANTS = [
    "-" * 5 + "BEGIN RSA PRIVATE" + " KEY" + "-" * 5 + "\nxyz\n" + "-" * 5 + "END RSA PRIVATE" + " KEY" + "-" * 5,
    "-" * 5 + "BEGIN PRIVATE" + " KEY cut off here",
    *(head + _BODY for head in ("sk-ant-", "sk-or-v1-", "sk-proj-", "sk-", "ghp" + "_", "ghs" + "_", "github" + "_pat_", "AI" + "za", "xox" + "b-", "hf" + "_", "npm" + "_", "glpat" + "-", "dckr" + "_pat_", "sk" + "_live_", "rk" + "_test_")),
    *(head + _UPPER for head in ("AK" + "IA", "AS" + "IA", "AR" + "OA", "AI" + "DA")),
    "https://hooks.slack.com/services/" + _BODY, "https://discord.com/api/webhooks/" + _BODY, "https://discordapp.com/api/webhooks/" + _BODY,
    "S" + "G." + _BODY[:20] + "." + _BODY[20:], "ey" + "J" + _BODY[:10] + "." + _BODY[10:20] + "." + _BODY[20:],
    "ftp://bob:pa55" + "word@host", "Authorization: Bearer " + _BODY[:18], "my password = correcthorsebattery", "API_KEY: '" + _BODY[:9] + "'", "my-session-key=" + _BODY[:9],
    "write a.b@example.org", "ssh deploy@build7 now", "/home/someone/x", "see /Users/someone.else", "C:\\Users\\someone\\y", "/root/.ssh", "in -home-someone-src", "in _Users_someone",
    "at 10.20.30.40 and 192.168.7.7", "at 172.20.1.1 not 172.40.1.1", "on nas-2.local", "on db.home.arpa", "call 555-123-4567", "call +1 (555) 123 4567", _HEX, _signs(33, "aB3/dE5+f"), _signs(30, "aB3_dE5-f"), "bell \x07 null-free \x01\x1b[0m\x7f",
]
_PLANTED = "(SELECT doc_id, v.plant || chr(10) || coalesce(text, '') AS text FROM documents JOIN (VALUES " + ", ".join(f"({k}, {_lit(p)})" for k, p in enumerate(PLANTS)) + f") v(k, plant) ON v.k = doc_id % {len(PLANTS)})"


def _planted(spark, sf):
    """Each document behind one thing that a rule is for, by its number."""
    plant = F.element_at(F.array(*[F.lit(p) for p in PLANTS]), F.pmod("doc_id", F.lit(len(PLANTS))).cast("int") + 1)
    return _read(spark, sf, "documents").select("doc_id", F.concat(plant, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@register(f"{_full_sql(_PLANTED)} SELECT doc_id, text FROM o")
def redact_planted(spark, sf):
    return _planted(spark, sf).select("doc_id", redact.redact_text(F.col("text")).alias("text"))


@register(_counts_sql(_PLANTED))
def redact_planted_counts(spark, sf):
    out = _planted(spark, sf).select(F.explode(redact.redact(F.col("text"))["counts"]).alias("label", "k"))
    return out.groupBy("label").agg(F.sum("k").alias("n"))


@register(
    _full_sql("(SELECT conv_id * 10000 + turn AS doc_id, text FROM conversations)")
    + f""", t AS (SELECT conv_id * 10000 + turn AS doc_id, conv_id, turn, CAST({tables.BASE_TS} + conv_id * 86400 + turn * 60 AS DOUBLE) AS ts, CASE role WHEN 'user' THEN 'user_request' WHEN 'assistant' THEN 'assistant_text' ELSE 'meta' END AS kind FROM conversations)
 SELECT left(CAST(conv_id AS VARCHAR), 8) AS session, 'conversations' AS source, CAST(turn AS INTEGER) AS seq, CAST(round_even(({NOW} - ts) / 86400.0, 0) AS BIGINT) AS age_days, kind, left(text, 1200) AS text FROM t JOIN o USING (doc_id)"""
)
def export_rows(spark, sf):
    turns = _conv(spark, sf)
    sessions = turns.select("session_key", "session_id", "source").distinct().withColumns({"title": F.lit(""), "turns": F.lit(0)})
    corpus = export.redacted_corpus(turns.drop("session_id"), sessions, NOW)
    return corpus.select("session", "source", "seq", "age_days", "kind", "text")


def _has(s: str, *patterns: str) -> str:
    return " + ".join(f"CAST(regexp_matches({s}, {_lit(p)}) AS INTEGER)" for p in patterns)


def _hits_sql(text: str, p: str) -> str:
    """A signature's matches; of one that looks around itself, over the doubled text."""
    if found := _looking(p):
        kept, bare, wide = found
        return f"CASE WHEN regexp_matches({text}, {_lit(bare)}) THEN regexp_extract_all({_twice_sql(text, kept)}, {_lit(wide)}) ELSE [] END"
    return f"regexp_extract_all({text}, {_lit(_unicode(p))})"


def _bits_sql(s: str) -> str:
    chars = f"string_split({s}, '')"
    count = f"len(list_filter({chars}, lambda d: d = c))"
    return f"list_sum(list_transform(list_distinct({chars}), lambda c: {count} / length({s}) * log2(length({s}) / {count})))"


@register(
    "SELECT label, CAST(sum(n) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT {_lit(label)} AS label, coalesce(sum(len({_hits_sql("coalesce(text, '')", p)})), 0) AS n FROM documents" for label, p in detect.SIGNATURES)
    + ") GROUP BY 1"
)
def audit_signatures(spark, sf):
    return detect.signature_counts(_read(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit(""))))


def _random_sql(s: str) -> str:
    """LEK26, LEK27 in SQL."""
    names = f"list_filter(string_split({s}, '/'), lambda n: n <> '')"
    bad = "NOT regexp_full_match(n, '-?[A-Za-z0-9][A-Za-z0-9._\\-]*') OR regexp_matches(n, '[A-Z]{2}')"
    path = f"(len({names}) > 1 AND len(list_filter({names}[1:-2], lambda n: {bad})) = 0)"
    return f"(length({s}) >= 24 AND (regexp_full_match({s}, '[0-9a-fA-F]{{32,}}') OR (regexp_matches({s}, '[0-9]') AND {_has(s, '[a-z]', '[A-Z]', '[0-9]', '[+/=_-]')} >= 3 AND NOT {path} AND {_bits_sql(s)} >= 3.7)))"


def _findings_sql() -> str:
    """Signatures, the second opinion on assignments and the sweep, line by line, behind
    masks taken out of the lines."""
    counts = []
    for label, p in detect.SIGNATURES:
        hits = _hits_sql("line", p)
        if label == detect.ASSIGNMENT:
            value = f"trim(regexp_replace(CASE WHEN contains(x, '=') THEN substring(x, strpos(x, '=') + 1) ELSE substring(x, strpos(x, ':') + 1) END, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), chr(34) || chr(39))"
            code = "regexp_matches(v, '[\\[\\]{}()<>$&|;`\\\\]')"
            name = "regexp_full_match(v, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+')"
            hits = f"list_filter(list_transform({hits}, lambda x: {value}), lambda v: v <> '' AND NOT {code} AND NOT {name} AND (length(v) >= 20 OR {_has('v', r'\p{Ll}', r'\p{Lu}', r'\p{Nd}', '[+/=_-]')} > 1))"
        counts.append(f"SELECT {_lit(label)} AS label, sum(len({hits})) AS n FROM l")
    cleared = "tok"
    for p in detect.HARMLESS:
        cleared = f"regexp_replace({cleared}, {_lit(p)}, '', 'g')"
    return f"""WITH l AS (SELECT regexp_replace(unnest(string_split_regex(coalesce(text, ''), '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')), {_lit(detect.MASK)}, '·', 'g') AS line FROM documents),
 a AS (SELECT unnest(regexp_extract_all(line, '{detect.TOKEN}')) AS tok FROM l), b AS (SELECT {cleared} AS w FROM a),
 d AS (SELECT w, list_filter(string_split_regex(w, '[_\\-/=+]'), lambda x: x <> '') AS parts FROM b),
 e AS (SELECT *, list_filter(parts, lambda x: length(x) = list_max(list_transform(parts, lambda y: length(y))))[1] AS longest FROM d),
 h AS (SELECT CASE WHEN regexp_full_match(w, '[0-9a-fA-F]{{32,}}') THEN '{detect.HEX_LABEL}' ELSE '{detect.TOKEN_LABEL}' END AS label FROM e WHERE len(parts) <= 3 AND {_random_sql("w")} OR {_random_sql("coalesce(longest, '')")}),
 u AS ({" UNION ALL ".join(counts)} UNION ALL SELECT label, count(*) FROM h GROUP BY 1)
 SELECT label, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY 1 HAVING sum(n) > 0"""


@register(_findings_sql())
def audit_findings(spark, sf):
    return detect.findings(_read(spark, sf, "documents"), "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT lang, source, round(sum(-c / n * log2(c / n)), 9) AS bits FROM (SELECT lang, source, ch, count(*) AS c, sum(count(*)) OVER (PARTITION BY lang, source) AS n FROM (SELECT DISTINCT lang, source, unnest(string_split(lang || '/' || source, '')) AS ch, generate_subscripts(string_split(lang || '/' || source, ''), 1) AS i FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def audit_entropy(spark, sf):
    pairs = _read(spark, sf, "documents").filter("lang is not null and source is not null").select("lang", "source").distinct()
    return pairs.select("lang", "source", F.round(detect.entropy(F.concat_ws("/", "lang", "source")), 9).alias("bits"))


@register(f"SELECT token, n, round({_bits_sql('token')}, 9) AS bits FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{detect.SIGN}+')) AS token FROM documents) GROUP BY 1)")
def audit_entropy_tokens(spark, sf):
    # each distinct token of the whole texts once
    tokens = _read(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(detect.SIGN + "+"), F.lit(0))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", "n", F.round(detect.entropy(F.col("token"), detect.SIGNS), 9).alias("bits"))


@register("SELECT CAST(0 AS BIGINT) AS findings, true AS raw_has_findings")
def audit_after_redaction(spark, sf):
    docs = _docs(spark, sf)
    safe = docs.select("turn_id", redact.redact_text(F.col("text")).alias("text"))
    raw = detect.findings(docs, "turn_id").agg((F.count(F.lit(1)) > 0).alias("raw_has_findings"))
    return detect.findings(safe, "turn_id").agg(F.count(F.lit(1)).alias("findings")).crossJoin(raw)  # one row by one row


@register("SELECT 'conversations' AS source, kind, count(*) AS n FROM (SELECT CASE role WHEN 'user' THEN 'user_request' WHEN 'assistant' THEN 'assistant_text' ELSE 'meta' END AS kind FROM conversations) GROUP BY 2 UNION ALL SELECT 'documents', 'tool_output', count(*) FROM documents")
def dedupe_union_sources(spark, sf):
    both = _conv(spark, sf).unionByName(_docs(spark, sf))
    return both.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


_PAGE = f"""{CONV}, h AS (SELECT *, lower(text || chr(10)) AS hay, CAST(floor(({NOW} - ts) / 86400.0) AS BIGINT) AS age FROM t WHERE kind <> 'meta'),
 p AS (SELECT *, {KIND_SQL} + 4 + CASE WHEN {_near_sql("the", "ing")} THEN 3 ELSE 0 END + CASE WHEN age <= 7 THEN 3 WHEN age <= 30 THEN 2 WHEN age <= 180 THEN 1 ELSE 0 END AS score FROM h WHERE contains(hay, 'the') AND contains(hay, 'ing'))"""


@register(f"{_PAGE} SELECT turn_id, CAST(score AS INTEGER) AS score, age FROM p ORDER BY score DESC, age, session_id, seq LIMIT 8")
def page_search(spark, sf):
    return page.page_search(_conv(spark, sf), ["the", "ing"], NOW).select("turn_id", "score", "age")


@register("""SELECT doc_id, CASE WHEN length(f) <= 260 THEN f ELSE CASE WHEN b > 0 THEN '…' ELSE '' END || substring(f, b + 1, 260) || CASE WHEN b + 260 < length(f) THEN '…' ELSE '' END END AS line
 FROM (SELECT *, CAST(greatest(coalesce(nullif(strpos(lower(f), 'license'), 0), nullif(strpos(lower(f), 'tion'), 0), 0) - 61, 0) AS BIGINT) AS b FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS f FROM documents))""")
def page_snip(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", page.page_snip(F.coalesce("text", F.lit("")), ["License", "tion"]).alias("line"))


@register("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)the', '<mark>\\0</mark>', 'g'), '(?i)\\.', '<mark>\\0</mark>', 'g') AS html FROM documents")
def page_highlight(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", page.highlight(F.coalesce("text", F.lit("")), ["The", "", "."]).alias("html"))


RECORDED = {"user": 250, "assistant": 10, "system": 20, "other": 5}


@register("SELECT coalesce(m.name, r.name) AS name, m.n AS now, r.n AS was FROM (SELECT role AS name, count(*) AS n FROM conversations GROUP BY 1) m FULL JOIN (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in RECORDED.items()) + ") r(name, n) USING (name) WHERE m.n IS NULL OR r.n IS NULL OR abs(m.n - r.n) / greatest(r.n, 1) > 0.4")
def drift_check(spark, sf):
    counted = _read(spark, sf, "conversations").groupBy(F.col("role").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return measure.drifted(counted, spark.createDataFrame(list(RECORDED.items()), "name string, n long"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: terms to ranked turns."""
    return search_terms_topk(spark, sf)
