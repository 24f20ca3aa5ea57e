"""What the two exact-substring operators share: the passes around their own kernels.

1. a sketch pass over all texts (``sketch.py``);
2. a second pass that keeps the windows estimated repeated, settles what repeats
   inside one slice of about 2 MB, and deals the first ones out by anchor hash;
3. kernels that settle each bucket.  A hot window reaches its bucket once a slice at
   most; beyond SALT_SLICES slices a salted round settles shares of them first;
4. the removed windows, as runs, return to their documents by (doc_id, text hash).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import SLICE_BYTES, pack, runs, text_bytes, unpack

ROW = pa.schema([("bucket", pa.int64()), ("salt", pa.int32()), ("did", pa.int64()), ("tid", pa.int64()), ("payload", pa.binary())])
ROW_SQL = "bucket long, salt int, did long, tid long, payload binary"
SALT_SLICES = 20_000
_REMOVED = ("<i4", "<i4")


def removed_rows(did: np.ndarray, tid: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple]:
    """A row for each document, under one of as many negative buckets as there are others,
    with the runs of its removed windows.  The bucket depends on the doc_id as well, so
    that a large group of copies, which share a text hash, is dealt out too."""
    if not len(pos):
        return []
    o = np.lexsort((pos, tid, did))
    did, tid, pos = did[o], tid[o], pos[o]
    first, n = runs(pos, did, tid)
    d, t, p = did[first], tid[first], pos[first]
    cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
    return [(-1 - (int(t[a]) + 0x9E3779B1 * int(d[a]) >> 7) % buckets, 0, int(d[a]), int(t[a]), pack(p[a:b].astype("<i4"), n[a:b].astype("<i4"))) for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True)]


def record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ROW)], schema=ROW)


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=ROW.names)


def find(
    docs: DataFrame,
    anchors: Callable,
    emit: Callable,
    settle: Callable,
    anchors_per_byte: float,
    bucket_bytes: int,
    max_salts: int = 1024,
    salt_slices: int = SALT_SLICES,
    max_bits: int = sketch.MAX_BITS,
) -> DataFrame:
    """docs: as ``keyed``.  anchors(batch) gives (document, hashes) of each slice;
    emit(batch, repeated, buckets, salts) gives rows, where repeated(document in the batch,
    hashes) looks hashes up; settle(rows of a bucket, buckets, last) gives removed rows and,
    unless last, what is still unsettled."""
    total, _ = text_bytes(docs, "_text")
    buckets = max(8, total // bucket_bytes)
    salts = min(max_salts, -(-total // (SLICE_BYTES * salt_slices)))
    bits = sketch.bits_for(total * anchors_per_byte)
    columns = ["_did", "_tid", "_text"]
    if bits <= max_bits:
        held = sketch.build(docs.select("_text"), lambda batch: (h for _, h in anchors(batch)), bits)
    else:  # a sketch too large to broadcast stays a table, and comes with each text
        held, columns = None, [*columns, "_repeated"]
        docs = sketch.with_repeated(docs, anchors, bits)

    def second(batches):
        for batch in batches:
            yield from emit(batch, held.repeated_of if held else sketch.listed(batch), buckets, salts)

    # settled rows travel along, under negative buckets, so that one pass makes both kinds
    rows = docs.select(*columns).mapInArrow(second, ROW_SQL)
    for last in [False, True] if salts > 1 else [True]:
        rows = rows.groupBy(*(["bucket"] if last else ["bucket", "salt"])).applyInPandas(_bound(settle, buckets, last), ROW_SQL)
    out = rows.filter("bucket < 0")
    return out.groupBy(F.col("did").alias("_did"), F.col("tid").alias("_tid")).agg(F.collect_list("payload").alias("_runs"))


def _bound(settle: Callable, buckets: int, last: bool) -> Callable:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf if pdf.bucket.iloc[0] < 0 else settle(pdf, buckets, last)

    return one


def runs_of(cells) -> tuple[np.ndarray, np.ndarray]:
    first, n = unpack(cells or [], *_REMOVED)
    return first.astype(np.int64), n.astype(np.int64)


def identity(batch: pa.RecordBatch, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """did, tid and the dense rank of (did, tid) of each row."""
    did = batch.column("_did").to_numpy(zero_copy_only=False)[rows]
    tid = batch.column("_tid").to_numpy(zero_copy_only=False)[rows]
    o = np.lexsort((tid, did))
    new = np.concatenate(([0], ((did[o][1:] != did[o][:-1]) | (tid[o][1:] != tid[o][:-1])).astype(np.int64)))
    rank = np.empty(len(o), np.int64)
    rank[o] = np.cumsum(new)
    return did, tid, rank
