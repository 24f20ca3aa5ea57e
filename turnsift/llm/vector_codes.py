"""Vector compression by a codebook for each part, over distinct parts.

Vectors become integers, floor(scale * x), and are cut into equal parts.  Equal parts of a
position are one row with a weight, so Lloyd's rounds run over distinct values; each round
is a pass with partial sums in the tasks and one row for each (position, entry, component)
at the driver, whatever the number of vectors.  Codes and errors are then joined back to
the vectors; a part that many vectors share is broadcast (common.spread_join).

All sums are exact: 64-bit where they are sure to fit, Python integers and decimals
elsewhere.  Components saturate at 2**50 either way, errors at the largest long.

Defined cases: a null vector, or one with a null or non-finite component, is dropped;
vectors shorter than the longest, or the longest one's next multiple of ``parts``, count
as followed by zeros, empty ones too; null vec_id orders first; the first codebook takes
the first rows by (vec_id, vector), so repeated ids and rows have one order; with fewer
vectors than entries the codebooks are shorter; null labels are one label; other columns
are ignored; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, scratch, small_batches, spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
MOST, LONG = 2**50, 2**63 - 1
BLOCK = 4096


def finite(vector: Column) -> Column:
    one = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, one)


def encode(x: np.ndarray) -> list[bytes]:
    """A cell for each row of integers: equal rows, and no others, have equal cells."""
    small, wide = x.astype(np.int16), x.astype("<i8")
    narrow = (small == x).all(axis=1)
    return [b"s" + small[k].tobytes() if narrow[k] else b"w" + wide[k].tobytes() for k in range(len(x))]


def decode(cells: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(cells), width), np.int64)
    narrow = np.array([c[:1] == b"s" for c in cells], bool)
    for kind, at in (("<i2", np.flatnonzero(narrow)), ("<i8", np.flatnonzero(~narrow))):
        if len(at):
            out[at] = np.frombuffer(b"".join(cells[k][1:] for k in at.tolist()), kind).reshape(len(at), width)
    return out


def _ints(values: pa.Array, n: int, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of integers, followed by zeros up to ``width``."""
    x = np.clip(np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)
    out = np.zeros((n, width), np.int64)
    row = np.repeat(np.arange(n), lengths)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (ties: the lower) and the squared distance."""
    most = max((int(np.abs(a).max()) for a in (x, book) if a.size), default=0)
    if x.shape[1] * (2 * most) ** 2 >= 2**62:
        x, book = x.astype(object), book.astype(object)
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for k in range(0, len(x), BLOCK):
        d = ((x[k : k + BLOCK, None, :] - book[None]) ** 2).sum(axis=2)
        code[k : k + BLOCK] = np.argmin(d, axis=1)
        far[k : k + BLOCK] = d[np.arange(len(d)), code[k : k + BLOCK]]
    return code, far


def _parts_of(batch: pa.RecordBatch, width: int):
    """(part position, rows, integers) of a batch of distinct parts."""
    at, cells = batch.column("p").to_numpy(zero_copy_only=False), batch.column("part").to_pylist()
    for p in np.unique(at).tolist():
        rows = np.flatnonzero(at == p)
        yield p, rows, decode([cells[k] for k in rows.tolist()], width)


def _lloyd(distinct: DataFrame, books: list[np.ndarray], width: int, rounds: int) -> list[np.ndarray]:
    """books after ``rounds`` rounds over the distinct parts (p, part, n)."""

    def sums_with(books):
        def task(batches):
            total: dict = {}
            for batch in batches:
                n = batch.column("n").to_numpy(zero_copy_only=False)
                for p, rows, x in _parts_of(batch, width):
                    code, _ = nearest(x, books[p])
                    weight = n[rows]
                    most = int(np.abs(x).max()) if x.size else 0
                    kind = np.int64 if max(most, 1) * int(weight.sum()) < 2**62 else object
                    scaled = x.astype(kind) * weight.astype(kind)[:, None]
                    for e in np.unique(code).tolist():
                        own = code == e
                        held = total.setdefault((p, e), [0, [0] * width])
                        held[0] += int(weight[own].sum())
                        held[1] = [a + int(b) for a, b in zip(held[1], scaled[own].sum(axis=0), strict=True)]
            flat = [(p, e, d, str(n), str(s)) for (p, e), (n, row) in total.items() for d, s in enumerate(row)]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), [pa.int32()] * 3 + [pa.string()] * 2, strict=True)], names=["p", "e", "d", "n", "s"])

        return task

    for _ in range(rounds):
        sums = distinct.mapInArrow(sums_with(books), "p int, e int, d int, n string, s string")
        whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "s")]
        books = [b.copy() for b in books]
        for r in sums.groupBy("p", "e", "d").agg(*whole).collect():
            books[r["p"]][r["e"], r["d"]] = int(r["s"]) // int(r["n"])
    return books


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (hex, two digits a part), error, label_error of each kept vector,
    and books: the final codebooks, by part, entry and component, as decimal text."""
    spark = vectors.sparkSession
    small_batches(spark)
    vector = column("embedding").cast("array<double>")
    kept = vectors.select(column("vec_id").cast("long").alias("vec_id"), column("label").alias("label"), vector.alias("v")).filter(finite(F.col("v"))).withColumn("rid", F.monotonically_increasing_id())
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))

    def cut(batches):
        for batch in batches:
            lists = batch.column("v")
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            x = _ints(lists.flatten(), batch.num_rows, lengths, parts * width).reshape(-1, width)
            cells = pa.array(encode(x), pa.binary())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cells) + 1, parts), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("vec_id"), batch.column("label"), rows], names=["rid", "vec_id", "label", "cells"])

    label = kept.schema["label"].dataType.simpleString()
    rows = scratch(kept.mapInArrow(cut, f"rid long, vec_id long, label {label}, cells array<binary>"), "parts")
    first = [r["cells"] for r in rows.orderBy(F.asc_nulls_first("vec_id"), "cells").limit(entries).select("cells").collect()]
    books = [decode([bytes(cells[p]) for cells in first], width) for p in range(parts)]

    each = rows.select("rid", "vec_id", "label", F.posexplode("cells").alias("p", "part"))
    distinct = scratch(each.groupBy("p", "part").agg(F.count(F.lit(1)).alias("n")), "distinct")
    books = _lloyd(distinct, books, width, rounds) if first else books

    def assign(batches):
        for batch in batches:
            code, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, x in _parts_of(batch, width):
                code[at], d = nearest(x, books[p])
                far[at] = np.minimum(d, LONG).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("p"), batch.column("part"), batch.column("n"), pa.array(code), pa.array(far)], names=["p", "part", "n", "code", "far"])

    coded = distinct.mapInArrow(assign, "p int, part binary, n long, code int, far long")
    named = spread_join(each, coded, ["p", "part"], "n")
    capped = lambda c: F.least(F.sum(c.cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    digits = F.array_sort(F.collect_list(F.struct("p", F.lpad(F.lower(F.hex("code")), 2, "0").alias("h"))))
    one = named.groupBy("rid").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.array_join(F.transform(digits, lambda s: s["h"]), "").alias("code"), capped(F.col("far")).alias("error"))
    one = scratch(one.withColumn("_label", F.to_json(F.struct("label"))), "codes")
    by_label = one.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"), capped(F.col("error")).alias("label_error"))
    shown = ",".join(str(v) for book in books for entry in book.tolist() for v in entry)
    out = spread_join(one, by_label, ["_label"], "_n")
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(shown).alias("books"))

