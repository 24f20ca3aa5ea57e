"""The registered queries: names, and a sample against DuckDB on a small folder."""

import math
import os
import re
from collections import Counter

import __spark_entry__ as entry
import duckdb
import pytest

from turnsift.audit import detect

SF = "/root/testdata/sf0.001"
TABLES = "events customer orders documents benchmark labels conversations".split()
SAMPLE = ["score_breakdown", "sessions_ranked", "phrase_bonus", "neighbours_range", "show_window", "tool_name_asof", "stats_span", "epoch_normalise", "clip_text", "error_signal_kind", "redact_email", "audit_signatures", "audit_entropy", "ingest_turns", "session_bounds_last_value", "prompt_recovery_anti", "redact_full", "redact_planted", "redact_planted_counts", "audit_findings", "phrase_bonus_three_terms", "search_folded", "page_snip", "excerpt_snip", "search_index_topk", "export_rows"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(near(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = con.sql(entry.oracle_sql()[name])
    want = sorted((tuple(near(dict(zip(out.columns, r, strict=True))[c]) for c in columns) for r in out.fetchall()), key=repr)
    assert sorted(out.columns) == columns and got == want


def test_all_signatures_are_counted(spark, tmp_path):
    texts = ["see /home/alice/x and 10.1.2.3, call 555-123-4567", None, "", "on nas.local and 192.168.1.9, bob@mail.example.com", "/Users/bob 1.10.1.2.3 x.internal"] * 2
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["label"]: r["n"] for r in entry.queries()["audit_signatures"](spark, str(tmp_path)).collect()}
    want = dict.fromkeys((label for label, _ in detect.SIGNATURES), 0)
    for label, p in detect.SIGNATURES:
        want[label] += sum(len(re.findall(p, t or "", re.A)) for t in texts)
    assert got == want
    assert all(want[x] > 0 for x in ("home directory path", "private network address", "private hostname", "telephone number"))


def test_entropy_of_all_tokens(spark, tmp_path):
    texts = ["the cat, the Dog=1", None, "", "é " + "aB3_" * 3000, "the end/of-it"]
    spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"]: (r["n"], r["bits"]) for r in entry.queries()["audit_entropy_tokens"](spark, str(tmp_path)).collect()}
    tokens = Counter(x for t in texts for x in re.findall(detect.SIGN + "+", t or ""))
    share = lambda w: [k / len(w) for k in Counter(w).values()]
    assert got == {w: (n, pytest.approx(-sum(p * math.log2(p) for p in share(w)), abs=1e-8)) for w, n in tokens.items()}
    assert got["the"][0] == 3 and got["aB3_" * 3000][1] == 2.0


ODD = [
    "555-123-4567 (555) 123-4567\n+1 555 123 4567", "555-123-4567(555) 123-4567", "1 555.123.4567 555.123.4567-", "٥٥٥-123-4567", "a 555-123-4567é+555-123-4567", None, "",
    "/home/ab/home/cd /home/ab/ /home/é", "/root/root/x /rooté", "10.0.0.1 10.0.0.2 10.0.0.3é", "nas.local.lan on x.lané y-z.internal", "deploy@build-Xy deploy@build7é", "0a1b2c3d" * 4 + "é",
    "bearer ABCDEFGHIJKLMNOPQbearer ABCDEFGHIJKLMNOPQ", "password = abcdefghijk1 apı_key=abcdefgh12", "password=[redacted:phone] token: Ünïcödé12345",
]


@pytest.mark.parametrize("name", ["redact_phone", "redact_columns", "redact_full", "audit_signatures", "audit_findings"])
def test_sql_states_the_rule(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
