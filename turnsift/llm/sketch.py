"""Saturating count-min sketch over window anchors, merged from all partitions.

Each cell holds 0, 1 or "2 or more".  A window is looked up by its anchor, the least
gram inside it.  Equal windows have equal anchors at equal offsets, so a window that
occurs twice has its anchor at two places at least: the sketch never estimates less
than the true count, and a window estimated at 1 is unique.  Cells are sent sparsely
(two bytes each), merged by shard in a tree, and only the bit "2 or more" is broadcast:
``2 * cells / 8`` bytes, at most 2**MAX_BITS cells a row (64 MB).

A larger sketch is not broadcast: ``with_repeated`` keeps it as a table of cells, one row
of them but eight cells for each anchor, merged by Spark's partial aggregation, and sends
the anchors that it counts at 2 or more back to their texts by joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, sliding

ROWS = 2
MIN_BITS, MAX_BITS = 17, 28
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_SENT = pa.schema([("pid", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
_SENT_SQL = "pid int, shard int, once binary, twice binary"


def bits_for(items: float) -> int:
    return int(max(np.ceil(np.log2(max(items, 1) * 2)), MIN_BITS))


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h * _ODD[row]) >> np.uint64(64 - bits)


def anchor_mask(grams: np.ndarray, least: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Which grams are the least of some valid window of ``w`` grams (ties: all)."""
    low = np.zeros(len(grams) + w - 1, np.uint64)
    low[w - 1 : w - 1 + len(least)] = np.where(valid, least, 0)
    return (sliding(low, w, np.maximum) == grams) & (grams > 0)


class Builder:
    """Gathers a task's anchors; ``flush`` gives rows for the merge."""

    def __init__(self, bits: int, pid: int, limit: int = 2_000_000):
        self.bits, self.pid, self.limit, self.held, self.n = bits, pid, limit, [], 0

    def add(self, h: np.ndarray):
        self.held.append(h.copy())
        self.n += len(h)
        if self.n >= self.limit:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        h = np.concatenate(self.held)
        self.held, self.n = [], 0
        out = {"pid": [], "shard": [], "once": [], "twice": []}
        for row in range(ROWS):
            c, k = np.unique(cells(h, row, self.bits), return_counts=True)
            shard, low = (c >> np.uint64(16)).astype(np.int64), (c & np.uint64(0xFFFF)).astype("<u2")
            first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            for a, b in zip(first, np.append(first[1:], len(c)), strict=True):
                out["pid"].append(self.pid)
                out["shard"].append(int(shard[a]) + (row << (max(self.bits, 16) - 16)))
                out["once"].append(low[a:b].tobytes())
                out["twice"].append(low[a:b][k[a:b] > 1].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _SENT], schema=_SENT)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    pid, rows = int(pdf.pid.iloc[0]), []
    for shard, part in pdf.groupby("shard"):
        count = np.zeros(65536, np.uint8)
        for once, twice in zip(part.once, part.twice, strict=True):
            i = np.frombuffer(once, "<u2")
            count[i] = np.minimum(2, count[i] + 1)
            count[np.frombuffer(twice, "<u2")] = 2
        rows.append((pid, shard, np.flatnonzero(count).astype("<u2").tobytes(), np.flatnonzero(count > 1).astype("<u2").tobytes()))
    return pd.DataFrame(rows, columns=["pid", "shard", "once", "twice"])


def build(source: DataFrame, add, bits: int) -> "Sketch":
    """``add`` maps an Arrow batch to arrays of anchor hashes, one for each place."""

    def task(batches):
        from pyspark import TaskContext

        b = Builder(bits, TaskContext.get().partitionId())
        for batch in batches:
            for h in add(batch):
                yield from b.add(h)
        yield from b.flush()

    parts = source.rdd.getNumPartitions()
    sent = source.mapInArrow(task, _SENT_SQL)
    fan = 64
    while True:
        sent = sent.withColumn("pid", F.floor(F.col("pid") / fan).cast("int"))
        sent = sent.groupBy("pid", F.floor(F.col("shard") / 16).alias("_g")).applyInPandas(_merge, _SENT_SQL)
        parts = -(-parts // fan)
        if parts <= 1:
            break
    n = 1 << (max(bits, 16) - 16)
    table = np.zeros((ROWS * n, 8192), np.uint8)
    for r in scratch(sent.select("shard", "twice").filter(F.length("twice") > 0), "sketch").toLocalIterator():
        bit = np.zeros(65536, np.uint8)
        bit[np.frombuffer(r.twice, "<u2")] = 1
        table[r.shard] = np.packbits(bit, bitorder="little")
    return Sketch(source.sparkSession.sparkContext.broadcast(table.reshape(ROWS, -1).copy()), bits)


def with_repeated(docs: DataFrame, anchors, bits: int) -> DataFrame:
    """docs with _repeated: the packed, sorted anchors of the text that the sketch counts
    at 2 or more.  anchors(batch) gives (document in the batch, hashes) of each slice."""

    def task(batches):
        for batch in batches:
            for d, h in anchors(batch):
                o = np.lexsort((h, d))
                d, h = d[o], h[o]
                first = np.flatnonzero(np.concatenate((np.ones(min(len(d), 1), bool), (d[1:] != d[:-1]) | (h[1:] != h[:-1]))))
                at, n = d[first].astype(np.int64), np.diff(np.append(first, len(d)))
                own = [batch.column(c).take(pa.array(at)) for c in ("_did", "_tid")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h[first].view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["_did", "_tid", "anchor", "n"])

    cell = F.shiftrightunsigned("anchor", max(64 - bits - 2, 0)).alias("cell")
    places = scratch(docs.select("_did", "_tid", "_text").mapInArrow(task, "_did long, _tid long, anchor long, n int").select("*", cell), "anchors")
    twice = places.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell")
    found = places.join(twice, "cell", "left_semi").groupBy("_did", "_tid").agg(F.collect_set("anchor").alias("_repeated"))
    return docs.join(found, ["_did", "_tid"])


def listed(batch: pa.RecordBatch):
    """The lookup of a batch that ``with_repeated`` made."""
    cells = batch.column("_repeated")

    def look_up(document: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for d in np.unique(document).tolist():
            own = document == d
            out[own] = np.isin(h[own], cells[d].values.to_numpy().view(np.uint64))
        return out

    return look_up


class Sketch:
    def __init__(self, held, bits: int):
        self.held, self.bits = held, bits

    def repeated_of(self, document: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.repeated(h)

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """Which are estimated at 2 or more."""
        out, t = np.ones(len(h), bool), self.held.value
        for row in range(ROWS):
            c = cells(h, row, self.bits)
            out &= (t[row][c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out
