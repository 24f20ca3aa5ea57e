"""Shared pieces of the training-data operators.

* ``scratch``      a written table in the folder all executors share; it cuts lineage
* ``text_slices``  Arrow text batches as flat UTF-8 bytes, in slices of bounded size
* ``words`` / ``rolling``  word bounds and polynomial hashes, vectorised
* ``pack`` / ``unpack``    several NumPy columns in one binary cell

Document identity is ``(doc_id, text)``: rows equal in both are one document, a null
``doc_id`` orders before all others, a null text is empty.  ``keyed`` adds the two
internal columns ``_did`` and ``_tid`` for that, after narrowing to the columns named,
so that further columns with any names do no harm.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
SLICE_BYTES, SMALL_SLICE = 2_000_000, 500_000
_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where unset (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="turnsift-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


_written: list[str] = []


def scratch(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, partitioned ``by`` columns if any, and read it
    back: computed once, lineage cut.  ``scratch_scope`` or ``clear_scratch`` removes what
    was written."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that this process has written with ``scratch``.  DataFrames made of it
    can't be read any more: call it when their results are written."""
    _remove(spark, _written)
    _written.clear()


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, keep: int = 0):
    """Removes, at its end, what ``scratch`` wrote inside, but for the last ``keep``."""
    held = len(_written)
    try:
        yield
    finally:
        stop = max(held, len(_written) - keep)
        _remove(spark, _written[held:stop])
        del _written[held:stop]


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB instead of Spark's 64 MB, unless the session has a setting of
    its own: a batch is held several times over on its way through a Python worker.
    Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def column(name: str) -> Column:
    """A column by its literal name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of docs with _did (null: first) and _tid, the text's 64-bit hash."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *[column(c) for c in columns],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_did"),
        F.xxhash64(text).alias("_tid"),
        text.alias("_text"),
    )


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """UTF-8 bytes and rows of all texts; sizes sketches and buckets, drops nothing."""
    r = df.agg(F.sum(F.octet_length(F.col(column).cast("string"))), F.count(F.lit(1))).first()
    return int(r[0] or 0), int(r[1])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HEAVY = 1000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with ``table`` (one row for each value of ``keys``, none null), where
    ``weight`` is how many rows have that value.  A value of more than 1/HEAVY of all rows
    is broadcast: there are fewer than HEAVY of those.  The rest are shuffled, and none of
    them is hot.  Both frames are read twice: written tables."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HEAVY > F.lit(total)
    heavy = F.broadcast(table.filter(hot))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(table.filter(~hot), keys)
    return rows.join(heavy, keys).unionByName(light)


# ---------------------------------------------------------------- Arrow text to bytes


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, end to end, and int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = pc.fill_null(column, "").cast(pa.large_string())
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Yields (rows, bytes, offsets): runs of whole rows of ``limit`` bytes or one row."""
    data, off = flat(batch.column(column))
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield slice(lo, hi), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


# ---------------------------------------------------------------- words and hashes

_GAP = re.compile(rb"[\x20\x09-\x0D]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """Starts and ends of the words (runs of bytes not in ``sep``), and the index of each
    row's first word (one more at the end).  A row's end ends a word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~sep[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[:-1][off[:-1] < len(data)]
    start[edge] = inside[edge]
    edge = off[1:][off[1:] > 0] - 1
    end[edge] = inside[edge]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, overlap: int = 0, sep: np.ndarray = SPACE):
    """Like text_slices, with a fourth value, and no slice much over ``limit``: a longer row
    comes in pieces that end between words, each with the last ``overlap`` words of the
    piece before.  The fourth value is the number of the row's words before the piece."""
    for rows, data, off in text_slices(batch, column, limit):
        if len(off) > 2 or len(data) <= 2 * limit:
            yield rows, data, off, 0
            continue
        a, before, size = 0, 0, limit
        while True:
            b = a + size
            while b < len(data) and not (gap := sep[data[b : b + 65536]]).any():
                b += len(gap)
            b = min(b + int(np.argmax(gap)), len(data)) if b < len(data) else len(data)
            starts = words(data[a:b], np.array([0, b - a]), sep)[0]
            if b < len(data) and len(starts) <= overlap:
                size *= 2  # words so long that the piece holds nothing new
                continue
            yield rows, data[a:b], np.array([0, b - a]), before
            if b == len(data):
                break
            step = len(starts) - overlap
            a, before, size = (a + int(starts[step]) if overlap else b), before + step, limit


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, overlap: int = 0):
    """The same by bytes: (rows, bytes, offsets, bytes of the row before the piece)."""
    for rows, data, off in text_slices(batch, column, limit):
        if len(off) > 2 or len(data) <= 2 * limit:
            yield rows, data, off, 0
            continue
        for a in range(0, max(len(data) - overlap, 1), limit):
            b = min(a + limit + overlap, len(data))
            yield rows, data[a:b], np.array([0, b - a]), a


def white_space_chunks(raw: bytes, size: int = SMALL_SLICE):
    """A text's words, a list for each stretch of about ``size`` bytes."""
    a = 0
    while a < len(raw):
        end = _GAP.search(raw, a + size) if a + size < len(raw) else None
        b = end.start() if end else len(raw)
        yield raw[a:b].split()
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hash modulo 2^64 over any range of a sequence, from one running sum.
    The families differ in their byte tables; the powers are one pair of arrays for all of
    a worker's families."""

    P = 0x2545F4914F6CDD1D & ~7 | 5
    up = down = np.ones(0, np.uint64)

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)

    @staticmethod
    def _powers(n: int) -> None:
        if len(Rolling.up) < n:
            n = max(n + n // 4, 1024)
            for name, base in (("up", Rolling.P), ("down", pow(Rolling.P, -1, 2**64))):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(a))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sums, one longer than ``values`` (bytes go through the table)."""
        n = len(values)
        self._powers(n + 1)
        c = np.zeros(n + 1, np.uint64)
        x = self.table[values] if values.dtype == np.uint8 else values
        np.cumsum(x * self.up[:n], out=c[1:])
        return c

    def spans(self, c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((c[ends] - c[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, c: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k``; as many as there are runs."""
        n = len(c) - k
        return mix((c[k:] - c[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding(a: np.ndarray, w: int, fold=np.minimum) -> np.ndarray:
    """Minimum (or other fold) of each run of ``w``, by doubling."""
    if len(a) < w:
        return a[:0]
    have = 1
    out = a
    while 2 * have <= w:
        out = fold(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = fold(out[: len(a) - w + 1], out[w - have : w - have + len(a) - w + 1])
    return out


# ---------------------------------------------------------------- packed columns


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, end to end; the reader names the types."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(cells, *types) -> list[np.ndarray]:
    """The columns that ``pack`` put into each cell, joined over all cells."""
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for cell in cells:
        n, at = len(cell) // width, 0
        for k, t in enumerate(types):
            out[k].append(np.frombuffer(cell, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)]


def runs(positions: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of consecutive positions with equal ``same``."""
    if not len(positions):
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.diff(positions) != 1
    for s in same:
        cut |= s[1:] != s[:-1]
    first = np.flatnonzero(np.concatenate(([True], cut)))
    return first, np.diff(np.append(first, len(positions)))


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def cover(length: int, first: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Mask of what windows of ``width`` starting at runs (first, n) cover."""
    d = np.zeros(length + 1, np.int64)
    np.add.at(d, first, 1)
    np.add.at(d, first + n - 1 + width, -1)
    return np.cumsum(d[:-1]) > 0
