"""Suffix-array dedup over bytes: two-stage suffix sorting and adjacent common prefixes.

``dedup_suffixes(docs, length=100)`` removes each byte covered by a string of
``length`` bytes that also starts earlier (smaller doc_id, or same document).

The kernel, ``two_stage``, is the two-stage sort: only the suffixes smaller than their
successor are compared directly; all others follow by one scan over the buckets of
first bytes.  Neighbours in the order with ``length`` common bytes are equal strings.
A sketch of window anchors leaves out stretches that are certainly unique; the kernel
then runs on what is left of a slice of text, and again on what remains of all slices,
dealt out by anchor hash, so that equal strings meet.  Each time it leaves out stretches
whose anchor is at one place only of what it is given.  Bytes decide, never hashes.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows
equal in doc_id and text are one document and each gets its result; a null doc_id
orders first; NUL bytes are bytes like others; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import Rolling, byte_slices, cover, flat, keyed, pack, runs, sliding, unpack
from .sketch import MAX_BITS, anchor_mask

GRAM, EXTRA = 32, 16
_B = Rolling(21)
_HEAD = ("<i8", "<i8", "<i8", "<i4", "<i4")  # did, tid, anchor, first window, windows
OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def two_stage(text: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Sorts the first n suffixes of each chunk to ``length`` bytes at least.

    Chunks are end to end in ``text``, each followed by one zero byte; ``start`` and
    ``size`` (without that byte) place them, and ``size >= n + length - 1``.  Each is
    read as though zeros without end followed.  Returns places in ``text``, sorted.
    """
    total = len(text)
    up = np.zeros(total, np.int8)
    up[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    up[start + size] = 1
    # equal neighbours: as the end of their run
    at = np.where(up != 0, np.arange(total), total)
    small = up[np.minimum.accumulate(at[::-1])[::-1]] > 0
    at = np.where(small, np.arange(total), total)
    following = np.minimum.accumulate(at[::-1])[::-1]
    last = following[start + n - 1]
    need = np.zeros(total + 1, np.int32)
    need[start] += 1
    need[last + 1] -= 1
    need = np.cumsum(need[:-1]) > 0
    head = np.zeros(total, bool)
    head[start] = True

    # stage one: direct comparison of the small ones
    s = np.flatnonzero(need & small)
    padded = np.concatenate((text, np.zeros(length, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, length)[s]
    end = (start + size)[np.searchsorted(start, s, side="right") - 1]
    for k in np.flatnonzero(end - s < length):
        rows[k, end[k] - s[k] :] = 0
    s = s[np.argsort(rows.view(f"S{length}").ravel(), kind="stable")]
    del rows
    at = np.searchsorted(text[s], np.arange(257)) if len(s) else np.zeros(257, np.int64)

    # stage two: the others, by bucket of their first byte, smallest bucket first
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        part = coming[c]
        turn = np.concatenate(part) if part else np.zeros(0, np.int64)
        coming[c] = []
        bucket = []
        while len(turn):
            bucket.append(turn)
            p = turn[~head[turn]] - 1
            turn = p[(text[p] == c) & ~small[p] & need[p]]
        bucket.append(s[at[c] : at[c + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        order.append(full)
        p = full[~head[full]] - 1
        p = p[need[p] & ~small[p] & (text[p] > c)]
        if len(p):
            q = text[p]
            o = np.argsort(q, kind="stable")
            q, p = q[o], p[o]
            cut = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(q)), strict=True):
                coming[q[a]].append(p[a:b])
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    wanted = np.zeros(total + 1, np.int32)
    wanted[start] += 1
    wanted[start + n] -= 1
    return order[np.cumsum(wanted[:-1])[order] > 0]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, length: int, block: int = 100_000) -> np.ndarray:
    """Common prefix, ``length`` at most, of each suffix with the one before it."""
    lcp = np.zeros(len(order), np.int32)
    view = np.lib.stride_tricks.sliding_window_view(text, length)
    for lo in range(1, len(order), block):
        hi = min(len(order), lo + block)
        rows = view[order[lo - 1 : hi]]
        other = rows[1:] != rows[:-1]
        lcp[lo:hi] = np.where(other.any(axis=1), other.argmax(axis=1), length)
    return lcp


def repeated(text, start, size, n, did, tid, first, length):
    """Windows (chunk, offset in it) that equal an earlier one, and the earliest ones."""
    order = two_stage(text, start, size, n, length)
    lcp = adjacent_prefixes(text, order, length)
    chunk = np.searchsorted(start, order, side="right") - 1
    at = order - start[chunk]
    # places in the order of (did, tid, offset); equal places are one
    o = np.lexsort((first, tid, did))
    base = np.cumsum(np.concatenate(([0], np.where((did[o][1:] != did[o][:-1]) | (tid[o][1:] != tid[o][:-1]), 1, 0))))
    rank = np.empty(len(o), np.int64)
    rank[o] = base
    place = rank[chunk] * np.int64(2**31) + first[chunk] + at
    group = np.flatnonzero(lcp < length)
    if not len(group):
        z = np.zeros(0, np.int64)
        return (z, z), (z, z)
    least = np.repeat(np.minimum.reduceat(place, group), np.diff(np.append(group, len(order))))
    gone = place != least
    return (chunk[gone], at[gone]), (chunk[~gone], at[~gone])


def _join(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    return text, np.concatenate(([0], np.cumsum(size + 1)[:-1])), size


def _cell(did, tid, anchor, first, n, data: bytes) -> bytes:
    """Several chunks in one cell: count, heads, sizes, bytes."""
    return pack(np.array([len(did)], "<i8"), did.astype("<i8"), tid.astype("<i8"), anchor.astype("<i8"), first.astype("<i4"), n.astype("<i4")) + data


def dedup_suffixes(docs: DataFrame, length: int = 100, salt_slices: int = repeats.SALT_SLICES, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (bytes)."""
    gram = min(GRAM, length)
    w = length - gram + 1
    tail = length - 1 + EXTRA

    def grams(data, off):
        if len(data) < length:
            return None
        doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
        valid = doc[: len(data) - length + 1] == doc[length - 1 :]
        g = _B.grams(_B.sums(data), gram)
        return g, sliding(g, w), valid, doc

    def anchors(batch):
        for rows, data, off, _ in byte_slices(batch, "_text", overlap=length - 1):
            if (x := grams(data, off)) is not None:
                at = np.flatnonzero(anchor_mask(x[0], x[1], x[2], w))
                yield rows.start + x[3][at], x[0][at]

    def rows_for(raw: bytes, begin, stop, did, tid, pos, anchor, n, buckets, salt):
        """Chunks dealt out by anchor.  begin, stop: of each chunk's bytes in raw."""
        b = (anchor.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], b[o][1:] != b[o][:-1])))
        out = []
        for a, z in zip(cut, np.append(cut[1:], len(o)), strict=True):
            k = o[a:z]
            size = (stop[k] - begin[k]).astype("<i4")
            data = size.tobytes() + b"".join([raw[i:j] for i, j in zip(begin[k].tolist(), stop[k].tolist(), strict=True)])
            out.append((int(b[k[0]]), salt, 0, 0, _cell(did[k], tid[k], anchor[k], pos[k], n[k], data)))
        return out

    def emit(batch, repeated_of, buckets, salts):
        for turn, (rows, data, off, before) in enumerate(byte_slices(batch, "_text", overlap=length - 1)):
            if (x := grams(data, off)) is None:
                continue
            g, low, valid, doc = x
            # a window can repeat in this slice only if its anchor is at two places of it
            anchor = np.sort(g[anchor_mask(g, low, valid, w)])
            again = anchor[1:][anchor[1:] == anchor[:-1]]
            i = np.flatnonzero(valid)
            i = i[repeated_of(rows.start + doc[i], low[i])]
            if not len(i):
                continue
            did, tid, _ = repeats.identity(batch, rows)
            low = low[i].view(np.int64)
            raw = data.tobytes()
            first, n = runs(i, low)
            inside = np.repeat(np.isin(low[first], again.view(np.int64)), n)
            left, out = np.flatnonzero(~inside), []  # indices into i
            inside = np.flatnonzero(inside)
            if len(inside):
                first, n = runs(i[inside], doc[i[inside]])
                begin = i[inside[first]]
                d = doc[begin]
                stop = np.minimum(begin + n + tail, off[d + 1])
                text, start, size = _join([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
                place = before + begin - off[d]
                gone, keep = repeated(text, start, size, n, did[d], tid[d], place, length)
                out = repeats.removed_rows(did[d][gone[0]], tid[d][gone[0]], place[gone[0]] + gone[1], buckets)
                left = np.sort(np.concatenate((left, inside[first[keep[0]] + keep[1]])))
            # rows equal in doc_id and text leave the same place twice; that does no harm
            at, m = runs(i[left], doc[i[left]], low[left])
            if len(at):
                begin = i[left[at]]
                d = doc[begin]
                stop = np.minimum(begin + m + tail, off[d + 1])
                salt = (int(did[0]) * 31 + turn) % max(salts, 1)
                out += rows_for(raw, begin, stop, did[d], tid[d], before + begin - off[d], low[left[at]], m, buckets, salt)
            yield repeats.record(out)

    def settle(pdf: pd.DataFrame, buckets: int, last: bool) -> pd.DataFrame:
        heads, pieces = [], []
        for cell in pdf.payload:
            k = int(np.frombuffer(cell, "<i8", 1)[0])
            wide = 32 * k
            heads.append(cell[8 : 8 + wide])
            sizes = np.frombuffer(cell, "<i4", k, 8 + wide).astype(np.int64)
            stops = np.cumsum(sizes) + 8 + wide + 4 * k
            pieces += [cell[a:b] for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
        did, tid, anchor, first, n = unpack(heads, *_HEAD)
        if last:  # a chunk's own windows differ; one whose anchor no other chunk has repeats nowhere
            _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
            k = np.flatnonzero(times[which] > 1)
            if not len(k):
                return repeats.frame([])
            did, tid, anchor, first, n = (x[k] for x in (did, tid, anchor, first, n))
            pieces = [pieces[x] for x in k.tolist()]
        first, n = first.astype(np.int64), n.astype(np.int64)
        text, start, size = _join(pieces)
        gone, keep = repeated(text, start, size, n, did, tid, first, length)
        out = repeats.removed_rows(did[gone[0]], tid[gone[0]], first[gone[0]] + gone[1], buckets)
        if not last:
            place = np.sort(start[keep[0]] + keep[1])
            chunk = np.searchsorted(start, place, side="right") - 1
            at, m = runs(place, chunk)
            k, begin = chunk[at], place[at]
            stop = np.minimum(begin + m + tail, (start + size)[k])
            out += rows_for(text.tobytes(), begin, stop, did[k], tid[k], first[k] + begin - start[k], anchor[k], m, 1, 0)
            out = [(int(pdf.bucket.iloc[0]) if r[0] >= 0 else r[0], *r[1:]) for r in out]
        return repeats.frame(out)

    source = keyed(docs, "doc_id")
    removed = repeats.find(source, anchors, emit, settle, 2.0 / (w + 1), 1_000_000, salt_slices=salt_slices, max_bits=max_bits)

    def finish(batches):
        for batch in batches:
            data, off = flat(batch.column("_text"))
            n_removed, n_spans, kept = [], [], []
            for k, cells in enumerate(batch.column("_runs")):
                text = data[off[k] : off[k + 1]]
                spans = 0
                if cells.is_valid:
                    mask = cover(len(text), *repeats.runs_of(cells.as_py()), length)
                    spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
                    text = text[~mask]
                n_removed.append(int(off[k + 1] - off[k]) - len(text))
                n_spans.append(spans)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = source.join(removed, ["_did", "_tid"], "left").select("doc_id", "_text", "_runs")
    return joined.mapInArrow(finish, OUT_SQL)
