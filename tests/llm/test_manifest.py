"""The Merkle manifest, vector codes and the trie join against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from small import frame

from turnsift.llm import merkle, simhash_join, vector_codes
from turnsift.llm.merkle import prove_documents
from turnsift.llm.simhash_join import near_components, near_documents, trie_links
from turnsift.llm.vector_codes import compress_vectors

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- manifest


def leaf(row, text):
    fields = (row[0], row[3], row[2], row[4], text)
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 3])) for k in range(0, len(out[-1]), 3)])
    return out


def steps(tree, k):
    for nodes in tree[:-1]:
        a = k // 3 * 3
        yield nodes[a:k], nodes[k + 1 : a + 3]
        k //= 3


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for at, (s, tree) in enumerate(zip(order, trees, strict=True)):
        for k, (_, _, mine, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            bends = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            path = [*steps(tree, k), *steps(top, at)]
            folded = leaf(r, r[1].replace("\n", "")) if bends else mine
            for left, right in path:
                folded = H("".join([*left, folded, *right]))
            proof = H("".join(x for both in path for side in both for x in side))
            out.append((r[0], mine, tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return Counter(out)


def documents(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choice(["", None, "a\nb", "é\n\n", "plain", "x" * 50]) if k % 3 else f"text {k}\nend"
        rows.append((rng.choice([k, k, k, None, 7]), text, rng.choice(["en", None]), rng.choice(["hot"] * 6 + [None, "", "b", "é", "z"]), rng.choice([None, 5])))
    return [*rows, rows[0], rows[0], (10**12, "long\n" * 400_000, "en", "hot", 1)]


def shown(df):
    return Counter(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


@pytest.mark.parametrize(("n", "span"), [(90, 1), (400, 6)])
def test_manifest(spark, monkeypatch, n, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle, "RUN_ROWS", 50)
    rows = documents(n)
    extra = spark.createDataFrame([(*r, "k", 1, b"d") for r in rows], DOC + ", tree string, _at int, digest binary").repartition(3)
    assert shown(prove_documents(extra)) == manifest(rows)


@pytest.mark.parametrize("n", [1, 4, 10])
def test_small_manifests(spark, n):
    rows = [(k, f"t\n{k}", "en", f"s{k % 2}", k) for k in range(n)]
    assert shown(prove_documents(spark.createDataFrame(rows, DOC))) == manifest(rows)


def test_proof_and_store(spark):
    rows = [(k, f"t{k}", "en", "s", k) for k in range(800)]
    built = merkle.build_manifest(spark.createDataFrame(rows, DOC))
    count = Counter(r["level"] for r in built.levels[0].select("level").collect())
    assert count == {0: 800, 1: 267, 2: 89, 3: 30, 4: 10, 5: 4, 6: 2} and len(built.levels) == 2
    one = merkle.proofs(built).filter("doc_id = 5").first()
    assert len(one["proof"]) % 64 == 0 and H(one["proof"]) == one["proof_sha256"] and one["folded_root"] == built.root


def test_empty_manifest(spark):
    none = spark.createDataFrame([], DOC)
    assert prove_documents(none).collect() == [] and merkle.build_manifest(none).root is None


# ---------------------------------------------------------------- vector codes

VEC = "vec_id long, embedding array<float>, label int"


def codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(p, cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k], strict=True)) if k in own else e for k, e in enumerate(books[p])]
    found = [(i, [near(p, x) for p, x in enumerate(cut(v))], label) for i, v, label in kept]
    by_label = Counter()
    for _, f, label in found:
        by_label[label] += sum(d for d, _ in f)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return Counter((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[label], text) for i, f, label in found)


def coded(df):
    return Counter(map(tuple, compress_vectors(df).select("vec_id", "code", "error", "label_error", "books").collect()))


def vectors(n=120, dim=16, seed=1):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(3 * k, [x + rng.choice([0, 0, 0.01]) for x in rng.choice(base)], rng.choice([0, 1, None])) for k in range(n)]
    return rows + [(1000 + k, base[0], 9) for k in range(80)]


def test_vector_codes(spark):
    rows = [*vectors(), (5000, None, 1), (5001, [float("nan")] * 16, 1), (5002, [float("-inf")] + [0.0] * 15, 1), (5003, [None] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], VEC + ", part string, n int, rid int").repartition(3)
    assert coded(df) == codes(rows)


def test_odd_vectors(spark):
    rows = [(None, [1.0, -2.0], 1), (4, [], None), (4, [0.5] * 11, None), (7, [-0.0001] * 8, 2), (8, [1e9, -1e9] * 4, 2)]
    assert coded(spark.createDataFrame(rows, VEC)) == codes(rows)
    huge = compress_vectors(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], VEC), entries=1).collect()
    assert {r["error"] for r in huge} == {vector_codes.LONG} == {r["label_error"] for r in huge}
    assert compress_vectors(spark.createDataFrame([], VEC)).collect() == []
    assert coded(spark.createDataFrame([(1, [], 0)], VEC)) == codes([(1, [], 0)])


def test_part_cells():
    x = np.array([[1, -2], [2**20, 0], [-(2**15), 2**15 - 1]])
    cells = vector_codes.encode(x)
    assert (vector_codes.decode(cells, 2) == x).all() and [c[:1] for c in cells] == [b"s", b"w", b"s"]


# ---------------------------------------------------------------- trie join


def fingerprint(text):
    w = (text or "").encode().translate(bytes(simhash_join.LOWER)).split()
    w = [x for x in w if x]
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near(prints, radius=2):
    """prints: (doc_id, fingerprint); the component of each."""
    parent = {f: f for _, f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    order = lambda d: (d is not None, d or 0)
    least = {}
    for d, f in prints:
        r = root(f)
        least[r] = min(least.get(r, d), d, key=order)
    return Counter((d, f"{f:016x}", least[root(f)]) for d, f in prints)


def test_near_documents(spark, docs, rows, none):
    assert Counter(map(tuple, near_documents(docs).collect())) == near([(d, fingerprint(t)) for d, t in rows])
    odd = [(None, "a b c"), (3, "a b c"), (4, None), (5, "  "), (6, "x" * 700_000 + " y z w"), (7, "w y " * 300_000)]
    assert Counter(map(tuple, near_documents(frame(spark, odd)).collect())) == near([(d, fingerprint(t)) for d, t in odd])
    assert near_documents(none).collect() == []


def test_print_is_what_spark_hashes(spark):
    one = spark.range(1).select(F.xxhash64(F.lit("only two")).alias("h")).first()["h"]
    assert int(simhash_join.fingerprints(["Only  TWO"])[0]) == one % 2**64


def flipped(rng, n, groups, bits):
    """Keys in groups of near ones, and some with a long common prefix."""
    out = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(n):
            x = base
            for _ in range(rng.randint(0, bits)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out | {rng.getrandbits(20) for _ in range(n)} | {0, 2**64 - 1})


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_trie_links(radius, monkeypatch):
    monkeypatch.setattr(simhash_join, "FRONT", 50)
    monkeypatch.setattr(simhash_join, "NEAR", 2)
    keys = flipped(random.Random(4), 40, 6, 4)
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if (keys[i] ^ keys[j]).bit_count() <= radius}
    a = np.array(keys, np.uint64)
    got = [p for i, j in trie_links(a, None, radius) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    half = len(a) // 2
    both = [p for i, j in trie_links(a[:half], a[half:], radius) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(both) == sorted((i, j - half) for i, j in want if i < half <= j)


@pytest.mark.parametrize("leaf", [7, 100_000])
def test_near_components_of_any_cut(spark, leaf):
    keys = flipped(random.Random(9), 60, 5, 3)
    prints = [(k * 5, f) for k, f in enumerate(keys)] + [(k * 5 + 1, keys[k % 3]) for k in range(50)]
    df = spark.createDataFrame([(d, f if f < 2**63 else f - 2**64) for d, f in prints], "_did long, key long")
    got = {r["key"] % 2**64: (r["n"], r["component"]) for r in near_components(df, leaf=leaf).collect()}
    want = {int(f, 16): c for _, f, c in near(prints)}
    assert {k: c for k, (_, c) in got.items()} == want and sum(n for n, _ in got.values()) == len(prints)
