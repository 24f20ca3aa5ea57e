"""Substring dedup, suffix dedup, Jaccard join, fingerprints: against brute force."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from small import frame

from turnsift.llm import common, queries, simhash, sketch
from turnsift.llm.components import components
from turnsift.llm.jaccard_join import boundary, link_documents
from turnsift.llm.substring_dedup import dedup_substrings
from turnsift.llm.suffix_dedup import adjacent_prefixes, dedup_suffixes, two_stage


@pytest.mark.parametrize("salt_slices", [20_000, 0.001])
def test_substring_dedup(docs, rows, salt_slices):
    slices = max(1, int(salt_slices)) if salt_slices > 1 else salt_slices
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in dedup_substrings(docs, 20, slices).collect())
    want = brute.words_removed(rows)
    assert got == sorted((d, *want[d, t]) for d, t in rows)
    assert sum(x[2] for x in got) > 100


@pytest.mark.parametrize("salt_slices", [20_000, 0.001])
def test_suffix_dedup(docs, rows, salt_slices):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_suffixes(docs, 100, salt_slices).collect())
    want = brute.bytes_removed(rows)
    assert got == sorted((d, *want[d, t]) for d, t in rows)


def test_a_sketch_too_large_to_broadcast(docs, rows):
    """The sketch as a table, joined: the same results."""
    words, text = brute.words_removed(rows), brute.bytes_removed(rows)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in dedup_substrings(docs, 20, max_bits=0).collect())
    assert got == sorted((d, *words[d, t]) for d, t in rows)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in dedup_suffixes(docs, 100, max_bits=0).collect())
    assert got == sorted((d, *text[d, t]) for d, t in rows)


def test_slices_of_long_rows():
    """Pieces together hold each window once, at its true place."""
    rng = random.Random(2)
    texts = ["a b", "", " ".join("".join(rng.choices("abé", k=rng.randint(1, 40))) for _ in range(700)), "x" * 3000 + " y z", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    for overlap in (0, 4):
        seen = [[] for _ in texts]
        for rows, data, off, before in common.word_slices(batch, "t", 200, overlap):
            starts, ends, first = common.words(data, off)
            raw = data.tobytes()
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                w = [raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                seen[rows.start + k] += [(before + i, *w[i : i + overlap + 1]) for i in range(len(w) - overlap)]
        for text, got in zip(texts, seen, strict=True):
            w = (text or "").encode().split()
            assert got == [(i, *w[i : i + overlap + 1]) for i in range(len(w) - overlap)]
    seen = [[] for _ in texts]
    for rows, data, off, before in common.byte_slices(batch, "t", 200, 9):
        raw = data.tobytes()
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            seen[rows.start + k] += [(before + i, raw[a + i : a + i + 10]) for i in range(b - a - 9)]
    for text, got in zip(texts, seen, strict=True):
        raw = (text or "").encode()
        assert got == [(i, raw[i : i + 10]) for i in range(len(raw) - 9)]
    assert [w for part in common.white_space_chunks((texts[2] or "").encode(), 50) for w in part] == (texts[2] or "").encode().split()


def test_a_very_long_text(spark):
    """Nine megabytes, in pieces: what repeats across them, within it and outside it."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"{x:x}" for x in (rng.getrandbits(40) for _ in range(n)))
    part, other = say(2000), say(1500)
    long = " ".join((part, say(380_000), part, say(380_000), other))
    docs = frame(spark, [(5, long), (7, other), (9, say(50)), (10, long + " end")])
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in dedup_substrings(docs, 20).collect()}
    n = 2 * 2000 + 760_000 + 1500
    assert got == {5: (n, 2000), 7: (1500, 1500), 9: (50, 0), 10: (n + 1, n)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in dedup_suffixes(docs, 100).collect()}
    assert got[9][1] == 0 and got[7] == (len(other), len(other), 1) and got[10] == (len(long) + 4, len(long), 1)
    assert got[5][0] == len(long) and len(part) <= got[5][1] <= len(part) + 8 and got[5][2] == 1
    joined = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in link_documents(docs).collect()}
    assert joined[5] == (len(shingled(long)), 5) and joined[10][1] == 5 and joined[7][1] == 7
    prints = {r["doc_id"]: r for r in simhash.edited_fingerprints(docs).collect()}
    assert prints[5]["n_chars"] == len(long) and int(prints[5]["fingerprint"], 16) != 0
    assert (int(prints[5]["fingerprint"], 16) ^ int(prints[10]["fingerprint"], 16)).bit_count() <= 3


def shingled(text):
    return brute.shingles(text, 3)


def test_places_among_splitters():
    splits = (np.array([3, 5, 5, 9]), np.array([0, -4, 8, 0]))
    rows = [(d, t) for d in range(12) for t in (-9, -4, 0, 8, 9)]
    got = simhash.place_among(np.array([d for d, _ in rows]), np.array([t for _, t in rows]), splits)
    assert got.tolist() == [sum((a, b) <= r for a, b in zip(*map(np.ndarray.tolist, splits), strict=True)) for r in rows]


def test_null_ids_and_empty_tables(spark, none):
    rows = [(None, "w " * 30), (5, "w " * 30 + "end"), (-3, "w " * 30)]
    small = frame(spark, rows)
    want = brute.words_removed(rows)
    assert sorted(((r[0], r[1], r[2]) for r in dedup_substrings(small, 20).collect()), key=repr) == sorted(((d, *want[d, t][:2]) for d, t in rows), key=repr)
    for out in (dedup_substrings(none), dedup_suffixes(none), link_documents(none), simhash.fingerprint_documents(none)):
        assert out.collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_two_stage_order(chunks):
    length = 6
    size = np.array([len(c) for c in chunks], np.int64)
    text = np.frombuffer(b"\0".join(chunks) + b"\0", np.uint8)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    n = size - length + 1
    order = two_stage(text, start, size, n, length)
    padded = {int(s + k): chunks[c][k:] + bytes(80) for c, s in enumerate(start) for k in range(int(n[c]))}
    assert sorted(order.tolist()) == sorted(padded)
    cut = [padded[i][:length] for i in order.tolist()]
    assert cut == sorted(cut)
    same = [x == y for x, y in zip(cut, cut[1:], strict=False)]
    assert (adjacent_prefixes(text, order, length)[1:] >= length).tolist() == same


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000).astype(np.uint64)
    h = np.concatenate((h, h[:500]))
    rows = spark.createDataFrame([(bytes(x.tobytes()),) for x in np.array_split(h, 40)], "b binary").repartition(5)
    held = sketch.build(rows, lambda batch: (np.frombuffer(x.as_py(), np.uint64) for x in batch.column(0)), 17)
    assert held.repeated(h[:500]).all()
    assert held.repeated(h[500:5000]).mean() < 0.2


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, rows, words, num):
    got = sorted(map(tuple, link_documents(docs, words, num, 100).collect()), key=repr)
    assert got == brute.linked(rows, words, num)
    assert len({x[2] for x in got}) < len({x[0] for x in got}) - 10


def test_jaccard_join_ids(spark):
    """Null ids, a doc_id with two texts, light sets at the boundary, a chain of links."""
    w = [f"w{k}" for k in range(60)]
    chain = [" ".join(w[k : k + 40]) for k in range(6)]
    rows = [(None, "a b c d e"), (9, "a b c d e"), (4, " ".join(w[:11])), (5, " ".join(w[:12])), (6, "q r s t"), (6, " ".join(w[:12])), *enumerate(chain, 20)]
    got = sorted(map(tuple, link_documents(frame(spark, rows), 3, 90, 100).collect()), key=repr)
    assert got == brute.linked(rows, 3, 90)
    assert boundary(90, 100) == 20 and boundary(80, 100) == 10


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 120), (120, 110), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (100, 110, 120)} == {100}


def test_fingerprints(docs, rows):
    got = simhash.fingerprint_documents(docs, radius=3).collect()
    ordered = sorted(rows, key=lambda r: r[0])
    texts = [t or "" for _, t in ordered]
    edited = {}
    for k, t in enumerate(texts):
        cut = len(t) // 4
        edited.setdefault(ordered[k][0], []).append(brute.sha((t[: len(t) - cut] + texts[(k + 1) % len(texts)][:cut]).encode()))
    ids = [d for d, _ in ordered]
    prints = {}
    for r in got:
        assert r["edited_sha256"] in edited[r["doc_id"]]
        prints[r["doc_id"]] = r["fingerprint"]
    assert sorted(r["doc_id"] for r in got) == ids
    assert prints[16] == prints[900] == prints[901] and prints[902] == prints[903] == "0" * 32
    as_int = {d: int(p, 16) for d, p in prints.items()}
    for r in got:
        near = sum((as_int[r["doc_id"]] ^ as_int[d]).bit_count() <= 3 for d in ids) - 1
        assert r["n_near"] == near
    long = [r for r in got if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.55


def test_edited_copies_are_near(spark, tmp_path):
    rng = random.Random(11)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(n)]
    shingles = lambda w: set(zip(*(w[k:] for k in range(5)), strict=False))
    rows, likes = [], []
    for k in range(60):  # two words of each hundred: 0.8 and more of the shingles stay
        w = say(200)
        e = list(w)
        for at in (20, 70, 120, 170):
            e[at] = "edited"
        s, t = shingles(w), shingles(e)
        likes.append(len(s & t) / len(s | t))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(e))]
    assert min(likes) >= 0.8
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_simhash(spark, str(tmp_path)).collect()
    by_id = {r["doc_id"]: r for r in got}
    caught = [k for k in range(60) if by_id[2 * k]["near_class"] == by_id[2 * k + 1]["near_class"]]
    assert len(caught) >= 54
    assert len({r["near_class"] for r in got}) == 120 - len(caught)
    f = {d: int(r["fingerprint"], 16) for d, r in by_id.items()}
    for d, r in by_id.items():
        assert r["n_near"] == sum((f[d] ^ x).bit_count() <= simhash.RADIUS for x in f.values()) - 1


def test_near_tables_are_lossless(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, (40, 2), dtype=np.uint64)
    f = np.repeat(base, 12, axis=0)
    for k in range(len(f)):
        for bit in rng.choice(128, rng.integers(0, 20), replace=False).tolist():
            f[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    pairs = lambda a, b, r, most: sorted((int(i), int(j)) for x, y in simhash.within(a, b, r, most) for i, j in zip(x, y, strict=True))
    monkeypatch.setattr(simhash, "PAIRS", 500)
    for radius in (0, 3, 26):
        far = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
        want = [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(far <= radius)), strict=True)]
        for most in (None, 0, min(radius, 1), min(radius, 2)):
            assert pairs(f, None, radius, most) == [(i, j) for i, j in want if i < j]
            assert pairs(f[:200], f[200:], radius, most) == [(i, j - 200) for i, j in want if i < 200 <= j]
    assert pairs(f[:0], None, 26, None) == pairs(f, f[:0], 26, None) == []
    # with more entries keys get longer, and what a table looks at a smaller share of all
    steps = [simhash.table_width(n, n, simhash.RADIUS) for n in (100, 1_000, 10_000, 100_000, 1_000_000)]
    assert steps == sorted(steps) and steps[-1] >= 2
    for most in range(1, 4):  # the bound behind the tables: some block has ``most`` bits at most
        assert (most + 1) * len(simhash._tables(simhash.RADIUS, most)) > simhash.RADIUS
    parent = np.arange(9)
    simhash._join(parent, np.array([8, 3, 5, 1]), np.array([3, 5, 1, 8]))
    simhash._join(parent, np.array([7, 7]), np.array([2, 6]))
    assert simhash._roots(parent, np.arange(9)).tolist() == [0, 1, 2, 1, 4, 1, 2, 2, 1]


def test_fingerprint_of_one(spark):
    r = simhash.edited_fingerprints(frame(spark, [(None, "abcd efgh")])).collect()
    assert len(r) == 1 and r[0]["doc_id"] is None and r[0]["near_next"] == 1.0
