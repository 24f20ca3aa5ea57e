"""Near-duplicates by SimHash fingerprints and a self-join of their binary trie.

A fingerprint has 64 bits.  A bit is set if it is set in more than half of the XXH64 hashes
(seed 42) of the text's shingles of three words, repeats included.  Fingerprints link at
``radius`` or fewer differing bits; a document's component is all it reaches by links.

Equal fingerprints are one key.  The trie of distinct keys is cut, by exact counts, into
subtrees of bounded size; keys travel to a task for each pair of subtrees whose prefixes
are within the radius.  There the two are traversed together, a level at a time: each pair
of nodes has the bits by which it differs so far, and goes no deeper beyond the radius.
A task returns a spanning forest of its links, and the forests are joined by
``components``.  A key has at most as many links as there are words within the radius
(2,080 for two bits), so no group can grow by the square of its size.

Defined cases: A-Z count as lower case; null, empty and blank texts have no words and
fingerprint zero, which links like any other; with one or two words the whole sequence is
the shingle; long texts are counted in pieces; null doc_id orders before all others and
names a component as null; repeated rows and ids are rows of their own; other columns are
ignored; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, SMALL_SLICE, keyed, pack, scratch, spread_join, unpack, word_slices, words
from .components import components
from .simhash import _join, _roots

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 2
#: Keys of a subtree at most, unless keys are so many that SUBTREES of them would be more.
LEAF, SUBTREES, STEP = 1 << 15, 1 << 14, 4
#: Pairs of nodes looked at together; pairs of keys below which two nodes are compared.
FRONT, NEAR = 1 << 18, 32
#: The mask of the first d bits.
TOP = np.array([(2**64 - 1) ^ (2 ** (64 - d) - 1) for d in range(65)], np.uint64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set, the lowest first."""
    seen = np.bincount((h.view(np.uint8).reshape(len(h), 8) + _PLACE).ravel(), minlength=2048)
    return (seen.reshape(8, 256) @ _SET).ravel()


def fingerprints(texts: list[str | None]) -> np.ndarray:
    counts, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    digest = xxhash.xxh64_intdigest
    for rows, raw, off, before in word_slices(batch, "text", SMALL_SLICE, SHINGLE - 1):
        data = LOWER[raw]
        starts, ends, first = words(data, off)
        if not len(starts):
            continue
        # the words with one space behind each
        size = ends - starts
        at = np.cumsum(size + 1) - size - 1
        flat = np.full(int(at[-1] + size[-1] + 1), 32, np.uint8)
        inside = np.repeat(starts - at, size) + (spread := np.arange(size.sum()) + np.repeat(np.arange(len(size)), size))
        flat[spread] = data[inside]
        joined, stop = flat.tobytes(), at + size
        lo, hi = at[: -SHINGLE + 1].tolist(), stop[SHINGLE - 1 :].tolist()
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo, hi, strict=True)], np.uint64)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b - a >= SHINGLE:
                some = h[a : b - SHINGLE + 1]
            elif b > a and not before:
                some = np.array([digest(joined[at[a] : stop[b - 1]], SEED)], np.uint64)
            else:
                continue
            counts[rows.start + k] += _bit_counts(some)
            total[rows.start + k] += len(some)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


# ---------------------------------------------------------------- the trie


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the nodes [lo, hi) of sorted keys, alike in ``depth`` bits, part at the next."""
    edge = (v[lo] & TOP[depth]) | np.uint64(1 << (63 - depth))
    return np.clip(np.searchsorted(v, edge), lo, hi)


def _met(a: np.ndarray, b: np.ndarray, front, radius: int):
    """All links of the pairs of nodes in front, key by key."""
    alo, ahi, blo, bhi, _, same = front
    wide = bhi - blo
    many = (ahi - alo) * wide
    at = np.repeat(np.arange(len(many)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    i, j = alo[at] + k // wide[at], blo[at] + k % wide[at]
    ok = (np.bitwise_count(a[i] ^ b[j]) <= radius) & (~same[at] | (i < j))
    return i[ok], j[ok]


def trie_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, depth: int = 0, used: int = 0):
    """Yields (i, j): each pair of a's i and b's j within the radius once; without b, of
    a's own keys, i before j.  Keys are sorted and distinct; the first ``depth`` bits are
    the same in all of a, and in all of b, and differ in ``used``."""
    own, b = b is None, a if b is None else b
    if not len(a) or not len(b):
        return
    one = lambda x, t=np.int64: np.array([x], t)
    stack = [(depth, (one(0), one(len(a)), one(0), one(len(b)), one(used), one(own, bool)))]
    while stack:
        depth, front = stack.pop()
        if len(front[0]) > FRONT:
            half = len(front[0]) // 2
            stack += [(depth, tuple(x[:half] for x in front)), (depth, tuple(x[half:] for x in front))]
            continue
        alo, ahi, blo, bhi, used, same = front
        small = ((ahi - alo) * (bhi - blo) <= NEAR) | (depth == BITS)
        if small.any():
            yield _met(a, b, tuple(x[small] for x in front), radius)
            alo, ahi, blo, bhi, used, same = (x[~small] for x in front)
        if not len(alo):
            continue
        am, bm = _split(a, alo, ahi, depth), _split(b, blo, bhi, depth)
        sides = [(alo, am, blo, bm, used, same), (am, ahi, bm, bhi, used, same), (alo, am, bm, bhi, used + 1, np.zeros_like(same)), (am, ahi, blo, bm, used + 1, np.zeros_like(same))]
        sides[3] = tuple(x[~same] for x in sides[3])  # the mirror of the third
        alo, ahi, blo, bhi, used, same = (np.concatenate(x) for x in zip(*sides, strict=True))
        go = (ahi > alo) & (bhi > blo) & (used <= radius)
        stack.append((depth + 1, tuple(x[go] for x in (alo, ahi, blo, bhi, used, same))))


def cut_trie(keys: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys and depths of subtrees with up to ``most`` keys that hold all keys, in
    order.  keys: distinct longs in ``key``.  STEP levels are counted at a time, below the
    nodes that have too many, of which there are no more than keys / most."""
    spark = keys.sparkSession
    n = keys.count()
    over, depth, cuts = ([(0, n)] if n > most else []), 0, ([(0, 0)] if n <= most else [])
    while over:
        depth += STEP
        child = F.shiftrightunsigned("key", BITS - depth).alias("child")
        rows = keys.select(child)
        if depth > STEP:
            rows = rows.withColumn("node", F.shiftrightunsigned("child", STEP)).join(F.broadcast(spark.createDataFrame([(p,) for p, _ in over], "node long")), "node")
        counted = [(r["child"], r["n"]) for r in rows.groupBy("child").agg(F.count(F.lit(1)).alias("n")).collect()]
        over = [(c if c < 2**63 else c - 2**64, k) for c, k in counted if k > most and depth < BITS]
        cuts += [((c % 2**64) << (BITS - depth), depth) for c, k in counted if k <= most or depth == BITS]
    cuts.sort()
    return np.array([c for c, _ in cuts], np.uint64), np.array([d for _, d in cuts], np.int64)


def near_components(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """prints (_did, key) -> key, n (rows) and component: the least _did reachable."""
    keys = scratch(prints.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("_did").alias("did")), "keys")
    first, depth = cut_trie(keys, max(leaf, keys.count() // SUBTREES))

    def deal(batches):
        for batch in batches:
            v = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            node = np.searchsorted(first, v, side="right") - 1
            for c in np.unique(node).tolist():
                shared = TOP[np.minimum(depth[c], depth)]
                near = np.flatnonzero(np.bitwise_count((first[c] ^ first) & shared) <= radius)
                cell, m = pack(v[node == c]), len(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c, near), pa.int64()), pa.array(np.maximum(c, near), pa.int64()), pa.array([c] * m, pa.int64()), pa.array([cell] * m, pa.binary())], names=["x", "y", "side", "cell"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf.x.iloc[0]), int(pdf.y.iloc[0])
        a, b = (np.sort(unpack(pdf.cell[pdf.side == s], "<u8")[0]) for s in (x, y))
        shared = int(min(depth[x], depth[y]))
        used = int(np.bitwise_count((first[x] ^ first[y]) & TOP[shared]))
        v, shift = (a, 0) if x == y else (np.concatenate((a, b)), len(a))
        parent = np.arange(len(v))
        for i, j in trie_links(a, None if x == y else b, radius, shared, used):
            _join(parent, i, j + shift)
        root = _roots(parent, np.arange(len(v)))
        some = np.flatnonzero(root != np.arange(len(v)))
        return pd.DataFrame({"a": v[some].view(np.int64), "b": v[root[some]].view(np.int64)})

    dealt = keys.select("key").mapInArrow(deal, "x long, y long, side long, cell binary")
    links = scratch(dealt.groupBy("x", "y").applyInPandas(join, "a long, b long"), "links")
    named = components(links).withColumnsRenamed({"node": "key", "component": "group"})
    grouped = scratch(keys.join(named, "key", "left").withColumn("group", F.coalesce("group", "key")), "grouped")
    least = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.min("did").alias("component"))
    return spread_join(grouped, least, ["group"], "_n").select("key", "n", "component")


def near_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""

    def task(batches):
        for batch in batches:
            f = fingerprints(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_did"), pa.array(f.view(np.int64))], names=["_did", "key"])

    prints = scratch(keyed(docs).select("_did", "_text").mapInArrow(task, "_did long, key long"), "prints")
    classes = scratch(near_components(prints, radius), "classes")
    known = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return spread_join(prints, classes, ["key"], "n").select(
        known("_did").alias("doc_id"), F.lower(F.lpad(F.hex("key"), 16, "0")).alias("fingerprint"), known("component").alias("component_id")
    )
