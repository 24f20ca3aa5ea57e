"""Size-aware heavy-light join of word-shingle sets by Jaccard similarity.

``link_documents(docs, words=3, num=90, den=100)`` links two documents when
``den * |A & B| >= num * |A | B|`` and returns each document's component.

* Equal sets are collapsed first (128-bit set hash), so a hot group of copies is one set.
* Light sets: every pair of sets below the boundary that links shares a subset of ``c``
  shingles, ``c`` its overlap; all subsets of the sizes possible are enumerated.
* Heavy sets: inverted lists over the rarest shingles of each set (as many as a link
  cannot miss), rarest first by a count-min sketch of all shingles, are scanned.  Light
  sets that may link to a heavy one are in the lists too.
* The boundary is the least size at which enumerating costs more than the lists.
* In a list, first only the smallest member is paired with the others.  Links found so
  join components; then each member is paired with its nearest one in another
  component; last, each pair of a list that is still in two components is tried.  Within
  a component no pair adds anything, so a group of g near copies costs about g.
* Candidates pass a parity-bitmap bound on the symmetric difference, which never drops
  a link, and then an exact intersection of the sets.

Defined cases: words are runs of bytes other than ASCII white space, A-Z in lower case;
fewer words than a shingle: the whole sequence is the one shingle; no words or a null
text: empty, linked with nothing, its own component.  Rows that share a doc_id are one
document; a null doc_id is a document that orders first (its component_id is null).
Other columns are ignored.  An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NULL_ID, SMALL_SLICE, Rolling, keyed, mix, pack, scratch, text_bytes, unpack, word_slices, words
from .components import components

_W, _S = Rolling(31), Rolling(32)
ORDER_BITS = 22
LIST_COST = 16
NEAREST_TURNS = 1
_SIG = pa.schema([("did", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.binary()), ("bits", pa.binary())])
_SIG_SQL = "did long, n int, h1 long, h2 long, keys binary, bits binary"
_DEAL_SQL = "bucket long, payload binary"
_POST = ("<u8", "<i8", "<i4")


def boundary(num: int, den: int, list_cost: float = LIST_COST) -> int:
    """The least set size at which the lists are cheaper than enumerating subsets."""
    n = 1
    while True:
        least = -(-num * n // den)
        if sum(comb(n, c) for c in range(least, n + 1)) > list_cost * (n - least + 1):
            return n
        n += 1


def shingle_rows(data: np.ndarray, off: np.ndarray, k: int):
    """Yields, for each row, its shingle hashes in text order."""
    data = LOWER[data]
    starts, ends, first = words(data, off)
    sums = _W.sums(data)
    w = _W.spans(sums, starts, ends)
    c = _S.sums(w)
    grams = _S.grams(c, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield grams[a : b - k + 1]
        elif b > a:
            yield _S.spans(c, np.array([a]), np.array([b]))
        else:
            yield grams[:0]


def shingle_slices(batch: pa.RecordBatch, k: int):
    """Yields (rows of the batch, shingle hashes of each); a long text's pieces as one."""
    held = None
    for rows, data, off, before in word_slices(batch, "_text", SMALL_SLICE, k - 1):
        if before:  # what overlaps is shorter than a shingle
            more = next(shingle_rows(data, off, k)) if len(words(data, off)[0]) >= k else held[1][0][:0]
            held = held[0], [np.concatenate((held[1][0], more))]
            continue
        if held:
            yield held
        found = list(shingle_rows(data, off, k))
        held = slice(rows.start, rows.start + len(found)), found
    if held:
        yield held


def _order(source: DataFrame, k: int) -> tuple:
    """Broadcast frequency class of each cell of a count-min sketch of all shingles.
    Only the order of the lists depends on it, so its width is fixed (4 MB)."""
    shift, shards = np.uint64(64 - ORDER_BITS), 64

    def task(batches):
        from pyspark import TaskContext

        count = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for _, found in shingle_slices(batch, k):
                rows = [r for r in found if len(r)]
                if rows:
                    count += np.bincount((np.concatenate(rows) >> shift).astype(np.int64), minlength=1 << ORDER_BITS)
        if count.any():
            count = np.minimum(count, 65535).astype("<u2").reshape(shards, -1)
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid] * shards, pa.int32()), pa.array(range(shards), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in count], pa.binary())],
                names=["pid", "shard", "counts"],
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << ORDER_BITS) // shards, np.int64)
        for c in pdf.counts:
            total += np.frombuffer(zlib.decompress(c), "<u2")
        packed = zlib.compress(np.minimum(total, 65535).astype("<u2").tobytes(), 1)
        return pd.DataFrame({"pid": [pdf.pid.iloc[0]], "shard": [pdf.shard.iloc[0]], "counts": [packed]})

    sql = "pid int, shard int, counts binary"
    parts, sent = source.rdd.getNumPartitions(), source.mapInArrow(task, sql)
    while True:
        sent = sent.withColumn("pid", F.floor(F.col("pid") / 64).cast("int")).groupBy("pid", "shard").applyInPandas(merge, sql)
        parts = -(-parts // 64)
        if parts <= 1:
            break
    count = np.zeros((shards, (1 << ORDER_BITS) // shards), np.int64)
    for r in sent.toLocalIterator():
        count[r.shard] = np.frombuffer(zlib.decompress(r.counts), "<u2")
    count = count.ravel()
    usual = 2 * count.mean() + 8
    cls = np.where(count <= usual, 0, 1 + np.log2(np.maximum(count, 1) / usual)).astype(np.uint8)
    return source.sparkSession.sparkContext.broadcast(cls), shift


def parity(s: np.ndarray) -> bytes:
    """Parity of the set's hashes in 4 n bits up to 1024, n / 2 bits beyond 2048 of them.
    Sets that can link differ by one doubling at most."""
    m = 64
    while m < max(min(4 * len(s), 1024), len(s) // 2):
        m *= 2
    bit = np.bincount(((s >> np.uint64(7)) % np.uint64(m)).astype(np.int64), minlength=m) & 1
    return np.packbits(bit.astype(np.uint8), bitorder="little").tobytes()


def _difference(a: bytes, b: bytes) -> int:
    """A lower bound on the size of the symmetric difference."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _most(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int):
    """The largest symmetric difference that linked sets of these sizes can have."""
    return (den - num) * (n + m) // (den + num)


def _fits(n, m, num, den):
    return den * np.minimum(n, m) >= num * np.maximum(n, m)


def _keys(s: np.ndarray, cls: np.ndarray, shift, num: int, den: int, edge: int) -> np.ndarray:
    n = len(s)
    least = -(-num * n // den)
    out = []
    if n < edge:
        for c in range(least, n + 1):
            gone = np.array(list(combinations(range(n), n - c)), np.int64)
            out.append(mix(s.sum(dtype=np.uint64) + np.full(len(gone), c, np.uint64) - s[gone].sum(axis=1, dtype=np.uint64)))
    if den * n >= num * edge:
        k = n - least + 1
        rank = cls[(s >> shift).astype(np.int64)]
        out.append(s[np.lexsort((s, rank))[:k]] if k < n else s)
    return np.concatenate(out) if out else s[:0]


def _deal(rows: DataFrame, buckets: int) -> DataFrame:
    """(rep, n, keys) dealt out by key: (bucket, packed (key, rep, n))."""

    def task(batches):
        for batch in batches:
            keys = [np.frombuffer(k.as_py(), "<u8") for k in batch.column("keys")]
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), size)
            n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), size).astype("<i4")
            b = (mix(key) % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            if not len(o):
                continue
            cut = np.flatnonzero(np.concatenate(([True], b[o][1:] != b[o][:-1])))
            stop = np.append(cut[1:], len(o))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[o][cut], pa.int64()), pa.array([pack(key[o[x:y]], rep[o[x:y]], n[o[x:y]]) for x, y in zip(cut, stop, strict=True)], pa.binary())],
                names=["bucket", "payload"],
            )

    return rows.select("rep", "n", "keys").mapInArrow(task, _DEAL_SQL)


def _verified(pairs: DataFrame, bits: DataFrame, source: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of documents that link.  bits: (rep, n, bits)."""

    def near(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
            most = _most(n, m, num, den)
            ok = [_difference(x.as_py(), y.as_py()) <= z for x, y, z in zip(batch.column("ba"), batch.column("bb"), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sets(batches):
        for batch in batches:
            for rows, found in shingle_slices(batch, k):
                s = [np.unique(x).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("_did").slice(rows.start, len(s)), pa.array(s, pa.binary())], names=["did", "s"])

    def exact(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                z = np.sort(np.concatenate((p, q)), kind="stable")
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = bits.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = bits.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    pairs = scratch(pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(near, "a long, b long").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("_did")).unionByName(pairs.select(F.col("b").alias("_did"))).distinct()
    held = scratch(source.select("_did", "_tid", "_text").join(ids.hint("shuffle_hash"), "_did", "left_semi").dropDuplicates(["_did", "_tid"]).select("_did", "_text").mapInArrow(sets, "did long, s binary"), "sets")
    both = pairs.join(held.select(F.col("did").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("did").alias("b"), F.col("s").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long").distinct()


def _unsettled(posts: DataFrame, found: DataFrame) -> DataFrame:
    """The lists (key, rep, n) whose members are in two components or more."""
    posts = posts.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = posts.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    return posts.join(mixed, "key", "left_semi")


def _crossing(num: int, den: int, every: bool):
    """Pairs of a list in two components that pass the bitmap bound: all of them, or for
    each member the nearest one, which keeps to a pair for each entry of a list."""

    def words_of(bits: list[bytes], width: int) -> np.ndarray:
        rows = np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
        return rows[:, :width] ^ rows[:, width:] if rows.shape[1] > width else rows

    def one(part: pd.DataFrame, found: set) -> None:
        part = part.sort_values("n", kind="stable")
        n, rep, comp = part.n.to_numpy(np.int64), part.rep.to_numpy(), part.component.to_numpy()
        width = np.array([len(b) // 8 for b in part.bits])
        bits = part.bits.tolist()
        for w in np.unique(width):
            # own width, then the next one folded: more than that no pair can differ
            own = np.flatnonzero(width == w)
            table = words_of([bits[i] for i in own], w)
            wide = np.flatnonzero(width == 2 * w)
            if len(wide):
                table = np.concatenate((table, words_of([bits[i] for i in wide], w)))
            at = np.concatenate((own, wide))
            for x, i in enumerate(own.tolist()):
                stop = int(np.searchsorted(n[at], n[i] * den // num, side="right"))
                ys = x + 1 + np.flatnonzero(comp[at[x + 1 : stop]] != comp[i])
                if not len(ys):
                    continue
                far = np.bitwise_count(table[ys] ^ table[x]).sum(axis=1, dtype=np.int64)
                ok = far <= _most(n[i], n[at[ys]], num, den)
                ys = ys[ok]
                if not every and len(ys):
                    ys = ys[[int(np.argmin(far[ok]))]]
                found.update((min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))) for j in at[ys])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: set = set()
        for _, part in pdf.groupby("key", sort=False):
            one(part, found)
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    return run


def link_documents(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, list_cost: float = LIST_COST) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (least doc_id reachable by links)."""
    if 2 * num < den:
        raise ValueError("the bounds hold for similarities of 1/2 and more")
    k, edge = words, boundary(num, den, list_cost)
    source = keyed(docs, "doc_id")
    total, _ = text_bytes(source, "_text")
    buckets = max(8, total // 2_000_000)
    cls, shift = _order(source.select("_text"), k)

    def sign(batches):
        for batch in batches:
            for rows, found in shingle_slices(batch, k):
                out = {f.name: [] for f in _SIG}
                for r in found:
                    s = np.unique(r)
                    out["n"].append(len(s))
                    out["h1"].append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    out["h2"].append(int(mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64).view(np.int64)))
                    out["keys"].append(_keys(s, cls.value, shift, num, den, edge).tobytes() if len(s) else b"")
                    out["bits"].append(parity(s))
                out["did"] = batch.column("_did").slice(rows.start, len(out["n"]))
                yield pa.RecordBatch.from_arrays([out["did"], *[pa.array(out[f.name], f.type) for f in list(_SIG)[1:]]], schema=_SIG)

    signed = scratch(source.select("_did", "_text").mapInArrow(sign, _SIG_SQL), "signed")
    same = ["h1", "h2", "n"]
    sets = scratch(signed.filter("n > 0").groupBy(*same).agg(F.min("did").alias("rep"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "sets")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """Lists of two or more: pairs with the smallest member, and the lists (b null)."""
        key, rep, n = unpack(pdf.payload, *_POST)
        o = np.lexsort((rep, n, key))
        key, rep, n = key[o], rep[o], n[o].astype(np.int64)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        long = np.append(np.flatnonzero(new)[1:], len(o)) - np.flatnonzero(new)
        size = np.repeat(long, long)
        # the pivot, or where sizes rule that out the member before
        mate = np.where(_fits(n, n[start], num, den), start, np.maximum(np.arange(len(o)) - 1, 0))
        ok = ~new & _fits(n, n[mate], num, den) & (rep != rep[mate])
        a, b = np.minimum(rep, rep[mate])[ok], np.maximum(rep, rep[mate])[ok]
        ab = np.unique(np.stack((a, b), 1), axis=0)
        more = size > 2
        none = np.zeros(len(ab), np.int64)
        return pd.DataFrame(
            {
                "a": np.concatenate((ab[:, 0], rep[more])),
                "b": np.concatenate((ab[:, 1], n[more])),
                "listed": np.concatenate((none.astype(bool), np.ones(int(more.sum()), bool))),
                "key": np.concatenate((none, key[more].view(np.int64))),
            }
        )

    lists = scratch(_deal(sets.filter(F.length("keys") > 0), buckets).groupBy("bucket").applyInPandas(scan, "a long, b long, listed boolean, key long"), "lists")
    tried = lists.filter("not listed").select("a", "b").distinct()
    bits = sets.select("rep", "n", "bits")
    found = scratch(_verified(tried, bits, source, k, num, den), "links")
    several = signed.filter("n > 0").groupBy("did").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x < y").select("did")
    if not several.isEmpty():  # a doc_id with several texts is one document
        own = signed.join(several, "did", "left_semi").join(sets.select(*same, "rep"), same)
        found = found.unionByName(own.select(F.col("did").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct())
    first = scratch(components(found), "components")

    # what is listed together but not yet in one component
    posts = lists.filter("listed").select("key", F.col("a").alias("rep"), F.col("b").cast("int").alias("n"))
    posts = scratch(_unsettled(posts, first), "mixed")
    for turn in range(NEAREST_TURNS + 1):
        if posts.isEmpty():
            break
        every = turn == NEAREST_TURNS
        rows = posts.join(bits, ["rep", "n"]).withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        rest = scratch(rows.groupBy("_bucket").applyInPandas(_crossing(num, den, every), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), "rest")
        if not every and rest.isEmpty():
            continue
        found = scratch(found.unionByName(_verified(rest, bits, source, k, num, den)), "links")
        first = scratch(components(found), "components")
        if every:
            break
        tried = scratch(tried.unionByName(rest), "tried")
        posts = scratch(_unsettled(posts.drop("component"), first), "mixed")

    named = sets.select(*same, "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = signed.select("did", *same).join(named, same, "left")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("did").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "did").alias("component")).select("doc_id", "n_shingles", real("component").alias("component_id"))
