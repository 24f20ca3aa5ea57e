"""Line numbers of split files and running values in chunks, against plain Python."""

import io
import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from turnsift.audit import detect
from turnsift.operators import segments
from turnsift.sources import parse, work
from turnsift.sources.archive import Source, lines


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_line_numbers_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(1)
    want = {}
    for name in ("a", "b", "c%20d"):
        texts = [rng.choice(["", "  ", json.dumps({"type": "user", "message": {"content": f"{name} {k} " + "é" * rng.randint(0, 40)}})]) for k in range(300)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(texts) + "\n", newline="")
        want |= {f"{name}.jsonl:{k}": t for k, t in enumerate(texts) if t.strip()}
    (tmp_path / "e.jsonl").write_text("")
    emitted = work.put(parse.emissions(lines(spark, Source("claude_code", str(tmp_path), True))), "emissions")
    assert emitted.select("path", "start").distinct().count() > 30
    rows = parse.numbered(emitted).filter("role = 'user_request'").collect()
    assert {f"{r['path'].split('/')[-1]}:{r['line_no']}": r["body"] for r in rows} == {k: json.loads(v)["message"]["content"] for k, v in want.items()}
    plan = parse.numbered(emitted)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 1 and "body" not in windows[0] and "sum(n" in windows[0]


def places(n=400, seed=3):
    rng = random.Random(seed)
    at = sorted({(rng.randint(0, 500), rng.randint(0, 3)) for _ in range(n)})
    return [(rng.choice("aaab"), rng.choice("xxy"), line, pos, rng.choice([None, None, f"v{line}"])) for line, pos in at]


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_running_values(spark, size):
    rows = places()
    df = spark.createDataFrame(rows, "path string, call string, line_no int, pos int, v string").repartition(5)
    seq, last, want = {}, {}, set()
    for path, call, line, pos, v in rows:
        key = (path, call)
        seq[key] = seq.get(key, -1) + 1
        last[key] = v or last.get(key)
        want.add((path, call, line, pos, v, seq[key], last[key]))
    both = segments.latest(segments.running_number(df, ["path", "call"], lines=size), ["path", "call"], F.col("v"), "last", lines=size)
    assert set(map(tuple, both.collect())) == want and both.count() == len(rows)


def test_chunks_bound_the_windows(spark):
    df = spark.createDataFrame(places(), "path string, call string, line_no int, pos int, v string")
    plan = segments.running_number(df, ["path"])._jdf.queryExecution().optimizedPlan().toString()
    assert all("_chunk" in x for x in plan.splitlines() if "row_number()" in x)


def test_work_folder(spark):
    df = work.put(spark.range(3).toDF("k"), "x")
    assert df.count() == 3
    work.clear(spark)
    assert not work._written


def test_audit_of_split_files(spark, tmp_path, small_splits):
    rng = random.Random(2)
    want, at = set(), 0
    with open(tmp_path / "big.txt", "wb") as f:
        for k in range(1, 401):
            text = rng.choice([b"plain words", b"", b"mail a@example.com", b"x\x00y", b"caf\xc3\xa9", b"b@example.com synthetic-fixture"])
            want |= {(k, "email address", b"exempt"[: 6 * text.startswith(b"b@")])} if b"@" in text else set()
            want |= {(0, detect.NUL_LABEL, f"offset {at + 1}".encode())} if b"\x00" in text else set()
            text += rng.choice([b"\n", b"\r\n"])
            f.write(text)
            at += len(text)
    records = detect.read_records(spark, str(tmp_path))
    assert records.select("start").distinct().count() > 5
    found = detect.scan_records(records).collect()
    assert {(r["line"], r["label"], r["snippet"].encode() if r["line"] == 0 else b"exempt" if r["exempt"] else b"") for r in found} == want


def test_tracked_files_and_streams(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "in.txt").write_text("a@example.com")
    (tmp_path / "out.txt").write_text("b@example.com")
    subprocess.run(["git", "-C", str(tmp_path), "add", "in.txt"], check=True)
    assert detect.tracked_files(str(tmp_path)) == [f"{tmp_path}/in.txt"]
    path = work.spool(spark, io.BytesIO(b"x\nc@example.com\n"), "stream", chunk=3)
    assert [(r["line"], r["label"]) for r in detect.scan_records(detect.read_records(spark, path)).collect()] == [(2, "email address")]
