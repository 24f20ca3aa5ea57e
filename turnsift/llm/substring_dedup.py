"""Substring dedup over words: count-min prefilter, then exact grouping.

``dedup_substrings(docs, window=20)`` removes each word covered by a window of
``window`` consecutive words whose sequence also starts earlier: in a document with a
smaller ``doc_id``, or earlier in the same document.  Windows are judged on the input.

Pass one builds count-min sketches of window anchors in each partition and merges them;
they overestimate, so a window estimated at one occurrence is unique and is left out.
Pass two groups the others exactly, by 192 bits of two independent hash families (the
anchor's and the window's), and all but the earliest occurrence of a sequence go.

Defined cases: a null or empty text has no words; a text shorter than a window loses
none; rows equal in doc_id and text are one document and each gets its result; a null
doc_id orders first; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import Rolling, cover, keyed, pack, sliding, unpack, white_space_chunks, word_slices, words
from .sketch import MAX_BITS, anchor_mask

GRAM = 8
_W1, _W2, _S1, _S2 = Rolling(11), Rolling(12), Rolling(13), Rolling(14)
_KEY = ("<i8", "<i8", "<i4", "<u8", "<u8", "<u8")
OUT_SQL = "doc_id long, n_words long, n_removed long, kept_text string"


def _windows(data, off, window: int, exact: bool):
    gram = min(GRAM, window)
    starts, ends, first = words(data, off)
    if len(starts) < window:
        return None
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    valid = doc[: len(starts) - window + 1] == doc[window - 1 :]
    sums = _S1.sums(_W1.spans(_W1.sums(data), starts, ends))
    grams = _S1.grams(sums, gram)
    least = sliding(grams, window - gram + 1)
    if not exact:
        at = np.flatnonzero(anchor_mask(grams, least, valid, window - gram + 1))
        return doc[at], grams[at]
    second = _S2.sums(_W2.spans(_W2.sums(data), starts, ends))
    return least, valid, doc, first, lambda i: (_S1.grams(sums, window)[i], _S2.grams(second, window)[i])


def _first_only(least, ha, hb, did, tid, pos):
    """Order by key and place; which are the earliest, and which repeat an earlier one."""
    o = np.lexsort((pos, tid, did, hb, ha, least))
    k = [x[o] for x in (least, ha, hb)]
    new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in k], axis=0)))
    head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    same = (did[o] == did[o][head]) & (tid[o] == tid[o][head]) & (pos[o] == pos[o][head])
    return o[new], o[~same]


def _rows(least, ha, hb, did, tid, pos, buckets, salt):
    """Unsettled windows, dealt out by anchor."""
    if not len(pos):
        return []
    b = (least % np.uint64(buckets)).astype(np.int64)
    o = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], b[o][1:] != b[o][:-1])))
    cols = [x[o] for x in (did, tid, pos.astype("<i4"), least, ha, hb)]
    return [(int(b[o[a]]), salt, 0, 0, pack(*[c[a:z] for c in cols])) for a, z in zip(cut, np.append(cut[1:], len(o)), strict=True)]


def dedup_substrings(docs: DataFrame, window: int = 20, salt_slices: int = repeats.SALT_SLICES, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space)."""

    def anchors(batch):
        for rows, data, off, _ in word_slices(batch, "_text", overlap=window - 1):
            if (found := _windows(data, off, window, False)) is not None:
                yield rows.start + found[0], found[1]

    def emit(batch, repeated, buckets, salts):
        for n, (rows, data, off, before) in enumerate(word_slices(batch, "_text", overlap=window - 1)):
            if (found := _windows(data, off, window, True)) is None:
                continue
            least, valid, doc, first, hashes = found
            i = np.flatnonzero(valid)
            i = i[repeated(rows.start + doc[i], least[i])]
            if not len(i):
                continue
            did, tid, _ = repeats.identity(batch, rows)
            d = doc[i]
            args = (least[i], *hashes(i), did[d], tid[d], before + i - first[d])
            keep, gone = _first_only(*args)
            keep.sort()
            salt = (int(did[0]) * 31 + n) % max(salts, 1)
            out = repeats.removed_rows(did[d][gone], tid[d][gone], args[5][gone], buckets)
            out += _rows(*[x[keep] for x in args], buckets, salt)
            yield repeats.record(out)

    def settle(pdf: pd.DataFrame, buckets: int, last: bool) -> pd.DataFrame:
        did, tid, pos, least, ha, hb = unpack(pdf.payload, *_KEY)
        keep, gone = _first_only(least, ha, hb, did, tid, pos)
        out = repeats.removed_rows(did[gone], tid[gone], pos[gone], buckets)
        if not last:
            out += [(int(pdf.bucket.iloc[0]), 0, 0, 0, pack(did[keep], tid[keep], pos[keep], least[keep], ha[keep], hb[keep]))]
        return repeats.frame(out)

    source = keyed(docs, "doc_id")
    removed = repeats.find(source, anchors, emit, settle, 0.024, 1_000_000, salt_slices=salt_slices, max_bits=max_bits)

    def finish(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, cells in zip(batch.column("_text"), batch.column("_runs"), strict=True):
                raw = text.as_py().encode()
                n = sum(map(len, white_space_chunks(raw)))
                mask = cover(n, *repeats.runs_of(cells.as_py()), window) if cells.is_valid else np.zeros(n, bool)
                left, at = [], 0
                for w in white_space_chunks(raw):
                    if some := [x for x, m in zip(w, mask[at : at + len(w)].tolist(), strict=True) if not m]:
                        left.append(b" ".join(some))
                    at += len(w)
                n_words.append(n)
                n_removed.append(int(mask.sum()))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    joined = source.join(removed, ["_did", "_tid"], "left").select("doc_id", "_text", "_runs")
    return joined.mapInArrow(finish, OUT_SQL)
