"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item; an
item of fewer words, but not none, is one pattern.  Patterns of one length form one
searcher: a table of word blocks gives the distance that is safe to skip, a skip of
zero leads to the bucket of patterns that end in this block, and a direct comparison
(word hashes, then the bytes) confirms.  Many cursors run through a slice in lockstep.
Table and block length grow with the patterns, so that most blocks stay skippable.

Patterns are cut out of the items and gathered on executors, as a written table, dealt
into blocks of about ``most`` patterns.  Only one block at a time passes through the
driver and is broadcast; several blocks are several passes, each written, so memory
stays bounded whatever the benchmark.  Rows that share an item_id are one item.  Long
texts are searched in pieces that overlap by the longest pattern.

Defined cases: a null or empty text has no words, hits nothing and is clean; repeated
rows each get their result; a null item_id is left out of the items but its windows hit;
further columns are ignored unless named in ``carry``; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, SMALL_SLICE, Rolling, column, cover, mix, scratch, small_batches, word_slices, words

MAX_PATTERNS = 200_000
SEPARATOR = np.ones(256, bool)
SEPARATOR[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = False
_W = Rolling(61)


def _split(data: np.ndarray, off: np.ndarray):
    data = LOWER[data]
    starts, ends, first = words(data, off, SEPARATOR)
    return data, starts, ends, first, _W.spans(_W.sums(data), starts, ends)


def _blocks(h: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    """Hash of the block of ``b`` words that ends at each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(b):
        out = mix(out + h[at - b + 1 + k])
    return out


class WuManber:
    """All patterns of ``m`` words.  rows: hashes (patterns x m); text: their words, each
    pattern's joined by a space."""

    def __init__(self, rows: np.ndarray, text: list[bytes]):
        self.m = m = rows.shape[1]
        self.b = b = min(2 if len(rows) < 20_000 else 3, m)
        self.default = m - b + 1
        # eight cells for each block of a pattern
        self.bits = int(np.clip(np.ceil(np.log2(8.0 * len(rows) * self.default)), 12, 24))
        self.shift = np.full(1 << self.bits, self.default, np.int32)
        flat = rows.ravel()
        for end in range(b - 1, m):
            block = _blocks(flat, np.arange(len(rows)) * m + end, b)
            np.minimum.at(self.shift, (block >> np.uint64(64 - self.bits)).astype(np.int64), m - 1 - end)
        last = _blocks(flat, np.arange(len(rows)) * m + m - 1, b)
        self.order = np.argsort(last, kind="stable")
        self.last, self.rows, self.text = last[self.order], rows, text

    def search(self, h: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all places whose hashes agree."""
        if len(h) < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(self.m - 1, len(h), step)
        stop = np.minimum(at + step, len(h))
        found = []
        while len(at):
            skip = self.shift[(_blocks(h, at, self.b)   >> np.uint64(64 - self.bits)).astype(np.int64)]
            if not skip.all():
                found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        block = _blocks(h, at, self.b)
        lo, hi = np.searchsorted(self.last, block, "left"), np.searchsorted(self.last, block, "right")
        n = hi - lo
        at, lo = np.repeat(at, n), np.repeat(lo, n)
        k = self.order[lo + np.arange(len(lo)) - np.repeat(np.cumsum(n) - n, n)] if len(lo) else lo
        start = at - self.m + 1
        same = (h[start[:, None] + np.arange(self.m)] == self.rows[k]).all(axis=1)
        return start[same], k[same]


def patterns(benchmark: DataFrame, window: int) -> DataFrame:
    """m (words), pattern (joined by a space) and items (array, null ids left out)."""

    def task(batches):
        for batch in batches:
            ids = batch.column("item").to_pylist()
            for rows, raw, off, before in word_slices(batch, "_text", SMALL_SLICE, window - 1, SEPARATOR):
                data, starts, ends, first, _ = _split(raw, off)
                data, out = data.tobytes(), ([], [], [])
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    w = [data[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                    m = window if before else min(window, len(w))
                    for i in range(len(w) - m + 1 if w else 0):
                        for col, value in zip(out, (m, b" ".join(w[i : i + m]), ids[rows.start + k]), strict=True):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string())], names=["m", "pattern", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return items.mapInArrow(task, "m int, pattern binary, item string").groupBy("m", "pattern").agg(F.collect_set("item").alias("items"))


def _searchers(rows) -> list[tuple[WuManber, list[list[str]]]]:
    """rows: (m, pattern, items), those of one block."""
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(r["m"], []).append((bytes(r["pattern"]), r["items"]))
    out = []
    for m, found in sorted(by_length.items()):
        text = [p for p, _ in found]
        data = np.frombuffer(b" ".join(text), np.uint8)
        edge = np.flatnonzero(data == 32)
        hashes = _W.spans(_W.sums(data), np.concatenate(([0], edge + 1)), np.append(edge, len(data))).reshape(-1, m)
        out.append((WuManber(hashes, text), [items for _, items in found]))
    return out


_FOUND = {"_hit": "array<bigint>", "_item": "array<string>", "_n": "bigint"}


def _search(rows: DataFrame, searchers, kept: list[str]) -> DataFrame:
    """rows with what these patterns hit added to _hit and _item."""
    held = rows.sparkSession.sparkContext.broadcast(searchers)
    overlap = max((s.m for s, _ in searchers), default=1) - 1

    def task(batches):
        for batch in batches:
            hits, items, count = ({}, {}, np.zeros(batch.num_rows, np.int64))
            for rows, raw, off, before in word_slices(batch, "_text", SMALL_SLICE, overlap, SEPARATOR):
                data, starts, ends, first, h = _split(raw, off)
                data = data.tobytes()
                doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
                count[rows] = before + np.diff(first)
                for searcher, names in held.value:
                    start, k = searcher.search(h)
                    whole = doc[start] == doc[start + searcher.m - 1] if len(start) else np.zeros(0, bool)
                    for s, p in zip(start[whole].tolist(), k[whole].tolist(), strict=True):
                        if b" ".join([data[starts[s + q] : ends[s + q]] for q in range(searcher.m)]) == searcher.text[p]:
                            d = int(doc[s])
                            hits.setdefault(rows.start + d, set()).add(before + s - int(first[d]) << 32 | searcher.m)
                            items.setdefault(rows.start + d, set()).update(names[p])
            old, own = batch.column("_hit").to_pylist(), batch.column("_item").to_pylist()
            for d in hits:
                old[d], own[d] = sorted({*(old[d] or []), *hits[d]}), sorted({*(own[d] or []), *items[d]})
            new = [pa.array(old, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.string())), pa.array(count)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*kept, "_text")], *new], names=[*kept, "_text", *_FOUND])

    return rows.mapInArrow(task, rows.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: tuple[str, ...] = ("doc_id",), most: int = MAX_PATTERNS) -> DataFrame:
    """The columns ``carry``, n_words, n_hit, items (array, sorted as strings) and hits
    (array of first word and number of words of each hit run)."""
    small_batches(docs.sparkSession)
    kept = {f"_c{k}": c for k, c in enumerate(carry)}
    none = [F.lit(None).cast(t).alias(c) for c, t in _FOUND.items()]
    rows = docs.select(*[column(c).alias(k) for k, c in kept.items()], F.coalesce(F.col("text"), F.lit("")).alias("_text"), *none)
    found = scratch(patterns(benchmark, window), "patterns")
    blocks = max(1, -(-found.count() // most))
    block = F.pmod(F.xxhash64("pattern"), F.lit(blocks))
    for k in range(blocks):
        rows = _search(rows, _searchers(found.filter(block == k).toLocalIterator()), list(kept))
        if blocks > 1:
            rows = scratch(rows, "searched")

    def finish(batches):
        for batch in batches:
            hits, n_hit = [], []
            for n, hit in zip(batch.column("_n").to_pylist(), batch.column("_hit").to_pylist(), strict=True):
                mask = np.zeros(n if hit else 0, bool)
                at = np.array(hit or [], np.int64)
                for m in np.unique(at & 0xFFFFFFFF):
                    first = at[at & 0xFFFFFFFF == m] >> 32
                    mask |= cover(n, first, np.ones(len(first), np.int64), int(m))
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                hits.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                n_hit.append(int(mask.sum()))
            span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            items = pa.array([x or [] for x in batch.column("_item").to_pylist()], pa.list_(pa.string()))
            cols = [*[batch.column(k) for k in kept], batch.column("_n"), pa.array(n_hit, pa.int64()), items, pa.array(hits, span)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_words", "n_hit", "items", "hits"])

    made = StructType.fromDDL("n_words bigint, n_hit bigint, items array<string>, hits array<struct<first:bigint,words:bigint>>")
    out = rows.drop("_text").mapInArrow(finish, StructType([*rows.select(*kept).schema.fields, *made.fields]))
    return out.select(*[F.col(k).alias(c) for k, c in kept.items()], "n_words", "n_hit", "items", "hits")
