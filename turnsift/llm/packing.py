"""Best-fit packing of token pieces with Martello-Toth dominance reduction.

``pack_documents(docs, tokenizer, capacity=1024, end_id=2)`` tokenizes each whole text,
appends the end id, cuts only longer documents into pieces of ``capacity`` (the first
piece may be shorter), and packs the pieces into few sequences.

Packing depends on lengths alone, so it is planned on their histogram (``capacity``
numbers, whatever the corpus): the reduction fixes sets that dominate every other set
holding the same piece, the rest goes by best fit, longest first.  The plan is a list
of intervals (length, ranks) -> (sequences, offset); ranks are dealt out by salted
windows, so one very common length does not meet in one task.  Pieces of full length
are sequences as they are.

Token ids are those of the ``tokenizers`` file.  Where a file of the same vocabulary
as ranks is beside it (``ranks``), texts go through it instead, which is faster; texts
holding the text of an added token always go through the tokenizer itself.

Defined cases: a null or empty text is the end id alone; null doc_id and repeated rows
are documents like others; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, small_batches

MAX_SALTS = 256
_PIECE_SQL = "doc_id long, part int, piece int, start long, length int, ids_crc32 long, ids binary"


class Plan:
    """Which ranks of each length go where."""

    def __init__(self, counts, capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        for size, n in enumerate(counts):
            self.left[size] = int(n)
        self.bins: list[tuple[int, tuple[int, ...]]] = []
        self._reduce()
        self.fixed = sum(m for m, _ in self.bins)
        self._best_fit()

    def _present(self, most: int, taken: tuple[int, ...] = ()) -> int:
        """The largest length up to ``most`` that is left beside those taken; or 0."""
        for size in range(min(most, self.capacity), 0, -1):
            if self.left[size] > taken.count(size):
                return size
        return 0

    def _smallest(self, k: int, taken: tuple[int, ...]) -> int:
        """The sum of the k smallest pieces left beside those taken (large: too few)."""
        total = 0
        for size in range(1, self.capacity + 1):
            n = min(k, self.left[size] - taken.count(size))
            if n > 0:
                total, k = total + n * size, k - n
                if not k:
                    return total
        return 10 * self.capacity

    def _dominating(self, j: int) -> tuple[int, ...]:
        """A set with a piece of length j that dominates all others with one; or none."""
        room = self.capacity - j
        k = self._present(room, (j,))
        if not k:
            return (j,)
        if k == room or self._smallest(2, (j,)) > room:
            return (j, k)
        if self._smallest(3, (j,)) > room:
            b = self._present(room - k, (j, k))
            above = next((s for s in range(b + 1, room + 1) if self.left[s] > (j, k).count(s)), 0)
            # no two pieces that both exceed b fit: (k, b) covers every pair
            if b and (not above or above + max(above, b + 1) > room):
                return (j, k, b)
        return ()

    def _fix(self, items: tuple[int, ...], times: int) -> None:
        for size in items:
            self.left[size] -= times
        self.bins.append((times, items))

    def _reduce(self) -> None:
        moved = True
        while moved:
            moved = False
            for j in range(self.capacity, 0, -1):
                while self.left[j] and (items := self._dominating(j)):
                    self._fix(items, min(self.left[s] // items.count(s) for s in items))
                    moved = True

    def _best_fit(self) -> None:
        open_bins: dict[int, list[list]] = {}
        for size in range(self.capacity, 0, -1):
            n, self.left[size] = self.left[size], 0
            while n:
                room = min((r for r, g in open_bins.items() if r >= size and g), default=0)
                times, items = open_bins[room].pop() if room else (n, ())
                room = room or self.capacity
                k = room // size
                whole = min(times, n // k)
                if whole:
                    open_bins.setdefault(room - k * size, []).append([whole, items + (size,) * k])
                    n, times = n - whole * k, times - whole
                if times and 0 < n < k:
                    open_bins.setdefault(room - n * size, []).append([1, items + (size,) * n])
                    n, times = 0, times - 1
                if times and items:
                    open_bins.setdefault(room, []).append([times, items])
        self.bins += [tuple(g) for group in open_bins.values() for g in group]

    @property
    def sequences(self) -> int:
        return sum(m for m, _ in self.bins)

    def intervals(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), sorted."""
        used, base, out = [0] * (self.capacity + 1), 0, []
        for times, items in self.bins:
            offset = 0
            for size in items:
                out.append((size, used[size], base, offset))
                used[size] += times
                offset += size
            base += times
        return np.array(sorted(out), np.int64).reshape(-1, 4)


class Encoder:
    """Token ids as little-endian 32-bit bytes.  Chunks that start at a single space are
    independent under the byte-level pattern, so each distinct chunk is encoded once."""

    MOST = 100_000

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast, self.held, self.odd = None, {}, re.compile(r" \s")
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.size = np.zeros(max(table.values()) + 1, np.int64)
            for token, k in table.items():
                self.size[k] = len(token)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks, all of which start with a space, in one call."""
        ids = np.array(self.fast.encode_ordinary("".join(chunks)), "<u4")
        ends = np.cumsum(self.size[ids])
        cut = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in chunks]), side="left") + 1
        a = 0
        for chunk, b in zip(chunks, cut.tolist(), strict=True):
            self.held[chunk] = ids[a:b].tobytes()
            a = b

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, parts, fresh = [b""] * len(texts), {}, {}
        for i, text in enumerate(texts):
            if self.fast is None or self.added is not None and self.added.search(text):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            elif self.odd.search(text) or text.endswith(" "):
                out[i] = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
            elif text:
                head, *rest = text.split(" ")
                rest = [" " + x for x in rest]
                parts[i] = head, rest
                fresh.update(dict.fromkeys(x for x in rest if x not in self.held))
        if fresh:
            self._learn(list(fresh))
        for i, (head, rest) in parts.items():
            first = np.array(self.fast.encode_ordinary(head), "<u4").tobytes() if head else b""
            out[i] = first + b"".join(map(self.held.__getitem__, rest))
        if len(self.held) > self.MOST:
            self.held.clear()
        return out


def tokenize(docs: DataFrame, tokenizer: str, ranks=None, pattern=None, capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, part (of the row's text), piece, start, length, ids_crc32, ids."""
    end = np.array([end_id], "<u4").tobytes()

    def task(batches):
        encode = Encoder(tokenizer, ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                rows = []
                for doc, part, ids in zip(some.column("doc_id").to_pylist(), some.column("part").to_pylist(), encode(some.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n - (n - 1) // capacity * capacity
                    a = 0
                    for piece, b in enumerate(range(first, n + 1, capacity)):
                        cell = ids[4 * a : 4 * b]
                        rows.append((doc, part, piece, a, b - a, zlib.crc32(cell), cell if keep_ids else None))
                        a = b
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "part", "piece", "start", "length", "ids_crc32", "ids"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64(text), F.lit(2**31 - 1)).cast("int").alias("part"), text.alias("text"))
    return rows.mapInArrow(task, _PIECE_SQL)


def pack_documents(docs: DataFrame, tokenizer: str, ranks=None, pattern=None, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept)."""
    pieces = tokenize(docs, tokenizer, ranks, pattern, capacity, end_id, keep_ids)
    pieces = scratch(pieces if keep_ids else pieces.drop("ids"), "pieces")
    # a full piece dominates every set with it: it is a sequence, and needs no rank
    alone = pieces.filter(F.col("length") == capacity).select(*[c for c in pieces.columns if c not in ("part", "length")], F.col("length").cast("long"), (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    salts = int(np.clip(4 * partitions(docs.sparkSession), 1, MAX_SALTS))
    pieces = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part", "piece", "start"), F.lit(salts)).cast("int"))
    counts = np.zeros((capacity + 1, salts), np.int64)
    for r in pieces.groupBy("length", "salt").count().collect():
        counts[r["length"], r["salt"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    plan = Plan(counts.sum(axis=1), capacity)
    where = plan.intervals()
    key = (where[:, 0] << 48) + where[:, 1]

    def place(batches):
        for b in batches:
            size, salt, rn = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rn"))
            rank = before[size, salt] + rn - 1
            k = np.searchsorted(key, (size << 48) + rank, side="right") - 1
            out = {"length": pa.array(size, pa.int64()), "sequence_id": pa.array(where[k, 2] + rank - where[k, 1], pa.int64()), "offset": pa.array(where[k, 3], pa.int64())}
            yield pa.RecordBatch.from_arrays([out[n] if n in out else b.column(n) for n in names], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "part", "piece")
    ranked = pieces.withColumn("rn", F.row_number().over(w)).drop("part")
    placed = ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * keep_ids)
    return placed.unionByName(alone)
