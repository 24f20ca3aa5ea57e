"""SimHash document fingerprints with permuted block tables.

``fingerprints`` gives 128 bits for a text: each term's hash votes with the term's
weight on every bit, and the sign of the sum is the bit.  Terms, each once a text:

* words (A-Z in lower case), weight ``min(bytes, 12)**2 / 144``: long words say more;
* runs of five words (fewer: the whole sequence), weight 1;
* in texts under 100 words, five-byte grams, weight fading from 1/4 to 0 at 100 words.

``likeness`` is the cosine that a Hamming distance stands for, 0 at least.

``near_classes`` finds, for each distinct fingerprint, how many documents lie within the
Hamming radius, and the class of all fingerprints reachable by such steps, named by the
least of them.  The radius, 26 bits, follows from the rule of 0.8 Jaccard similarity of
five-word shingles; the README has the measured recall.

The search is lossless.  Equal fingerprints are collapsed; the others are dealt into
groups, and each pair of groups is one task, which emits sums and a spanning forest, not
pairs.  A task cuts the bits into ``radius // (k + 1) + 1`` blocks: two fingerprints
within the radius differ by k bits at most in one block at least, so each block is the key
of one table (the permutation that puts it first), and an entry is compared with those
whose keys are within k bits.  k follows from the entries' number by cost, so keys grow
with it; every k finds the same pairs.  A pair that meets in several tables counts in the
first.

Defined cases: null text is empty; the empty text's fingerprint is all zeros; null
doc_id orders first; rows equal in doc_id and text are neighbours in any order; other
columns are ignored; the only document is its own next one; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, SMALL_SLICE, Rolling, keyed, mix, pack, partitions, scratch, text_bytes, unpack, word_slices, words
from .components import components

_W, _S = Rolling(91), Rolling(92)
BITS, SHINGLE, GRAM, SHORT = 128, 5, 5, 100
#: Hamming radius; entries of a group.
RADIUS, GROUP = 26, 750_000
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2) - 1
_PLACE = np.arange(BITS // 8, dtype=np.int64) * 256


def _votes(h: np.ndarray, weight: np.ndarray, block: int = 200_000) -> np.ndarray:
    """Fingerprint of terms: one weighted histogram of hash bytes, then signs."""
    seen = np.zeros(256 * BITS // 8)
    for k in range(0, len(h), block):
        some = h[k : k + block]
        both = np.stack((some, mix(some ^ np.uint64(0x2545F4914F6CDD1D))), 1)
        at = both.view(np.uint8).reshape(len(some), BITS // 8) + _PLACE
        seen += np.bincount(at.ravel(), np.repeat(weight[k : k + block], BITS // 8), minlength=len(seen))
    total = np.einsum("bv,vk->bk", seen.reshape(BITS // 8, 256), _SIGNS).ravel()
    return np.packbits(total > 0, bitorder="little").view(np.uint64)


def _unique(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, with its weight."""
    h, at = np.unique(np.concatenate([p for p, _ in pieces]), return_index=True)
    return h, np.concatenate([w for _, w in pieces])[at]


def fingerprints(texts: list[str]) -> np.ndarray:
    """Two 64-bit words for each text."""
    out = np.zeros((len(texts), 2), np.uint64)
    held: list = []  # terms of the row so far, a long one's pieces together

    def vote() -> None:
        if held and held[1]:
            out[held[0]] = _votes(*(np.concatenate(x) for x in zip(*map(_unique, held[1:]), strict=True)))

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for rows, raw, off, before in word_slices(batch, "text", SMALL_SLICE, SHINGLE - 1):
        data = LOWER[raw]
        starts, ends, first = words(data, off)
        sums = _W.sums(data)
        h = _W.spans(sums, starts, ends)
        size = np.minimum(ends - starts, 12) ** 2 / 144.0
        c = _S.sums(h)
        runs = _S.grams(c, SHINGLE)
        for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if not before:
                vote()
                held = [rows.start + k, [], []]
            if a == b:
                continue
            run = runs[a : b - SHINGLE + 1] if b - a >= SHINGLE else _S.spans(c, np.array([a]), np.array([b]))[: 0 if before else 1]
            held[1].append(_unique([(h[a:b], size[a:b])]))
            held[2].append(_unique([(run, np.ones(len(run)))]))
            if not before and b - a < SHORT and off[k + 1] - off[k] >= GRAM:
                lo, hi = int(off[k]), int(off[k + 1])
                gram = np.unique(mix((sums[lo + GRAM : hi + 1] - sums[lo : hi - GRAM + 1]) * _W.down[lo : hi - GRAM + 1]))
                held.append([(gram, np.full(len(gram), 0.25 * (1 - (b - a) / SHORT)))])
    vote()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = np.bitwise_count(a ^ b).sum(axis=-1)
    return np.maximum(0.0, np.cos(np.pi * far / BITS))


def _hex(f: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in f.tolist()]


_EDIT = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


RANGE_BYTES, DRAWS = 32 << 20, 8


def _splitters(source: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(_did, _tid) of quantiles of rows drawn in proportion to their bytes, DRAWS a range."""
    u = F.pmod(F.xxhash64("_did", "_tid", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    draws = F.least(F.floor((F.octet_length("_text") + 1) * (ranges * DRAWS / max(total, 1)) + u), F.lit(ranges * DRAWS))
    drawn = source.select("_did", "_tid", draws.cast("int").alias("n")).filter("n > 0").toPandas()
    did, tid = (np.repeat(drawn[c].to_numpy(np.int64), drawn.n) for c in ("_did", "_tid"))
    o = np.lexsort((tid, did))
    at = np.linspace(0, len(o), ranges + 1).astype(int)[1:-1] if len(o) else np.zeros(0, int)
    both = np.unique(np.stack((did[o][at], tid[o][at]), 1), axis=0)
    return both[:, 0], both[:, 1]


def place_among(did: np.ndarray, tid: np.ndarray, splits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of splitters at or before each (did, tid)."""
    lo, hi = (np.searchsorted(splits[0], did, side=s) for s in ("left", "right"))
    for d in np.unique(did[hi - lo > 0]).tolist():  # splitters with this very id
        own = did == d
        a, b = int(np.searchsorted(splits[0], d)), int(np.searchsorted(splits[0], d, side="right"))
        lo[own] = a + np.searchsorted(splits[1][a:b], tid[own], side="right")
    return lo


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt out in ranges of (doc_id, text hash), each range followed by the first
    row of the next one (``_last``), sorted.  Ranges hold about RANGE_BYTES of text, so a
    doc_id that many rows share is many ranges."""
    source = keyed(docs, "doc_id")
    spark, (total, _) = docs.sparkSession, text_bytes(docs)
    ranges = max(2 * partitions(spark), total // RANGE_BYTES)
    splits = spark.sparkContext.broadcast(_splitters(source, total, ranges))

    @F.pandas_udf("int")
    def range_of(did: pd.Series, tid: pd.Series) -> pd.Series:
        return pd.Series(place_among(did.to_numpy(np.int64), tid.to_numpy(np.int64), splits.value).astype(np.int32))

    cut = source.withColumn("_part", range_of("_did", "_tid")).withColumn("_last", F.lit(False))
    heads = cut.groupBy("_part").agg(F.min(F.struct("_did", "_tid")).alias("h")).orderBy("_part").collect()
    if not heads:
        return cut
    before = [heads[-1], *heads[:-1]]
    ghosts = spark.createDataFrame([(h.h["_did"], h.h["_tid"], p["_part"]) for h, p in zip(heads, before, strict=True)], "_did long, _tid long, _to int")
    extra = cut.join(F.broadcast(ghosts), ["_did", "_tid"]).groupBy("_did", "_tid", "_to").agg(F.first("doc_id").alias("doc_id"), F.first("_text").alias("_text"))
    extra = extra.select("doc_id", "_did", "_tid", "_text", F.col("_to").alias("_part"), F.lit(True).alias("_last"))
    return cut.unionByName(extra).repartition(ranges, "_part").sortWithinPartitions("_part", "_last", "_did", "_tid")


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """For each document its own fingerprint, that of its text with the last
    1/``share`` of the code points replaced by the start of the next document, and the
    likeness to the edited text and to the next document."""

    def block(rows, following):
        """rows: (doc_id, part, text) in order; following: the text after the last."""
        texts = [r[2] for r in rows]
        nexts = [*texts[1:], following]
        edited = []
        for t, n in zip(texts, nexts, strict=True):
            cut = len(t) // share
            edited.append(t[: len(t) - cut] + n[:cut])
        f = fingerprints([*texts, following, *edited])
        own, after, other = f[: len(rows)], f[1 : len(rows) + 1], f[len(rows) + 1 :]
        cols = [[None if r[0] == NULL_ID else r[0] for r in rows], [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], _hex(own), _hex(other), likeness(own, other), likeness(own, after)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=list(_EDIT))

    def task(batches):
        held, size, part = [], 0, None
        for batch in batches:
            for did, text, p, last in zip(*(batch.column(c).to_pylist() for c in ("_did", "_text", "_part", "_last")), strict=True):
                if p != part:
                    held, size, part = [], 0, p
                if held and (last or size > 500_000):
                    yield block(held, text)
                    held, size = [], 0
                if not last:
                    held.append((did, p, text))
                    size += len(text)

    return _with_next(docs).select("_did", "_text", "_part", "_last").mapInArrow(task, ", ".join(f"{k} {t}" for k, t in _EDIT.items()))


#: Widest key of a table; pairs looked at together; seconds, roughly, that a mask costs, an
#: entry's look-up under a mask, and a pair looked at.
KEY, PAIRS = 20, 1 << 20
PER_MASK, PER_LOOKUP, PER_PAIR = 6e-5, 1.2e-8, 1.5e-8


def _tables(radius: int, most: int) -> list[np.ndarray]:
    """The bits that make the key of each table: so many blocks that two fingerprints
    within the radius differ by ``most`` bits at most in one of them at least."""
    return [bits[:KEY] for bits in np.array_split(np.arange(BITS), radius // (most + 1) + 1)]


def _masks(width: int, most: int) -> np.ndarray:
    """All words of ``width`` bits with ``most`` of them set at most."""
    return np.array([sum(1 << k for k in c) for n in range(most + 1) for c in combinations(range(width), n)], np.int64)


def table_width(n: int, m: int, radius: int) -> int:
    """How many differing bits a table forgives, by cost: with more entries, fewer and
    longer keys under more masks, so that a smaller share of all pairs is looked at."""

    def cost(most: int) -> float:
        each = [(len(bits), sum(comb(len(bits), k) for k in range(most + 1))) for bits in _tables(radius, most)]
        return sum(masks * (PER_MASK + n * PER_LOOKUP + n * m / 2**width * PER_PAIR) for width, masks in each)

    return min(range(min(radius, 4) + 1), key=cost)


def _keys(f: np.ndarray, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Each table's key of every fingerprint."""
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), BITS // 8), axis=1, bitorder="little")
    return [bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64)) for at in tables]


def within(a: np.ndarray, b: np.ndarray | None, radius: int, most: int | None = None):
    """Yields (i, j): each pair of a's i and b's j within the radius once; without b, of
    a's own entries, i before j.  Each table holds b in order of its key; under each mask
    an entry of a is compared with those whose key is its own but for the mask."""
    own, b = b is None, a if b is None else b
    most = table_width(len(a), len(b), radius) if most is None else most
    tables = _tables(radius, most)
    ka = _keys(a, tables)
    kb = ka if own else _keys(b, tables)
    for t, bits in enumerate(tables):
        oa, ob = np.argsort(ka[t], kind="stable"), np.argsort(kb[t], kind="stable")
        key, fa, fb = ka[t][oa], a[oa], b[ob]
        start = np.concatenate(([0], np.cumsum(np.bincount(kb[t], minlength=1 << len(bits)))))
        for mask in _masks(len(bits), most):
            lo = start[key ^ mask]
            size = start[(key ^ mask) + 1] - lo
            met = np.flatnonzero(size)
            lo, size = lo[met], size[met]
            total = np.cumsum(size)
            # runs of entries with about PAIRS pairs, one entry at least
            cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) + 1, [len(met)]))) if len(met) else [0]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                i = np.repeat(met[x:y], size[x:y])
                j = np.arange(len(i)) + np.repeat(lo[x:y] - total[x:y] + size[x:y] + (total[x - 1] if x else 0), size[x:y])
                far = np.bitwise_count(fa[i, 0] ^ fb[j, 0])
                some = np.flatnonzero(far <= radius)
                i, j, far = i[some], j[some], far[some]
                far += np.bitwise_count(fa[i, 1] ^ fb[j, 1])
                some = far <= radius
                i, j = oa[i[some]], ob[j[some]]
                ok = i < j if own else np.ones(len(i), bool)
                for w in range(t):  # counted in the first table in which the two meet
                    ok &= np.bitwise_count(ka[w][i] ^ kb[w][j]) > most
                yield i[ok], j[ok]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = parent[at]
    while (parent[at] != at).any():
        at = parent[at]
    return at


def _join(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of all i and j; a root is the least of its tree."""
    while len(i):
        p, q = _roots(parent, i), _roots(parent, j)
        parent[i], parent[j] = p, q
        i, j = np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]
        parent[j] = i


def near_classes(prints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """fingerprint -> n_near: other documents whose fingerprint is within ``radius``;
    near_class: the least fingerprint reachable by steps within it."""
    counts = scratch(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    groups = max(8, -(-counts.count() // group))

    def deal(batches):
        for batch in batches:
            f = np.array([(int(x[:16], 16), int(x[16:], 16)) for x in batch.column("fingerprint").to_pylist()], np.uint64).reshape(-1, 2)
            n, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "node"))
            dealt = (mix(f[:, 0] + mix(f[:, 1].copy())) % np.uint64(groups)).astype(np.int64)
            for g in np.unique(dealt).tolist():
                rows = dealt == g
                cell = pack(f[rows, 0], f[rows, 1], n[rows], node[rows])
                x, y = np.minimum(g, np.arange(groups)), np.maximum(g, np.arange(groups))
                yield pa.RecordBatch.from_arrays([pa.array(x * groups + y, pa.int64()), pa.array([g] * groups, pa.int64()), pa.array([cell] * groups, pa.binary())], names=["tile", "side", "payload"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = divmod(int(pdf.tile.iloc[0]), groups)
        sides = [unpack(pdf.payload[pdf.side == g], "<u8", "<u8", "<i8", "<i8") for g in ((x,) if x == y else (x, y))]
        f = [np.stack((s[0], s[1]), 1) for s in sides]
        n, node = (np.concatenate([s[k] for s in sides]) for k in (2, 3))
        shift = 0 if x == y else len(f[0])
        near, parent = np.zeros(len(n), np.int64), np.arange(len(n))
        for i, j in within(f[0], None if x == y else f[1], radius):
            if len(i):
                j = j + shift
                np.add.at(near, i, n[j])
                np.add.at(near, j, n[i])
                _join(parent, i, j)
        some = np.flatnonzero(near)
        return pd.DataFrame({"node": node[some], "near": near[some], "root": node[_roots(parent, some)]})

    dealt = counts.select("fingerprint", "n", "node").mapInArrow(deal, "tile long, side long, payload binary")
    found = scratch(dealt.groupBy("tile").applyInPandas(compare, "node long, near long, root long"), "near")
    named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("near").alias("near"))
    out = counts.join(sums, "node", "left").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = out.groupBy("component").agg(F.min("fingerprint").alias("near_class"))
    return out.join(least, "component").select("fingerprint", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "near_class")


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """edited_fingerprints with n_near and near_class of each document's own fingerprint."""
    out = scratch(edited_fingerprints(docs), "prints")
    return out.join(near_classes(out, radius), "fingerprint").select(*_EDIT, "n_near", "near_class")
