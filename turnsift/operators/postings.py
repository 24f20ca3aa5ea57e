"""A positional term index and top-k search with an early stop (JON2, SNK4, SRT1, FLT10).

``ranked`` lays the turns out in the order of their points that do not depend on a query
(kind, then time) and numbers them; ``postings`` has, for each term, field and block of
2**bits such numbers, the turns and the places that hold the term: Arrow batches of turns
in order are whole rows of it, which one shuffle deals out by term.  Its Parquet files are
sorted by (term, field, block) with delta-coded numbers, so that a term is a few pages.
No posting is longer than a block, whatever the term's frequency.

A search joins the blocks of its terms: sets of turns are intersected within a block, a
phrase by shifting places.  Each posting has the best kind and the latest time of its
turns, so a block has an upper bound of what its turns can score.  ``top`` reads texts
from the best level of bounds downwards, and stops when no block left can place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import kind_points, recency_points
from ..functions.text import fold_column, term_tokens
from ..schema import PHRASE_POINTS, TERM_POINTS
from .filters import Filters
from .search import best_first, score, top_turns, with_sessions

BITS = 12
FIELDS, TOKENS = ("text", "target"), ("text_tok", "target_tok")
#: Blocks of a term, as a power of two, that stay together.
SPREAD = 6
#: Small row groups and pages, and delta codes instead of dictionaries.
PARQUET = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "500", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Index:
    ranked: DataFrame
    postings: DataFrame
    bits: int = BITS


@dataclass
class Reads:
    """How many blocks hold all terms, and of how many the turns were read."""

    blocks: int = 0
    read: int = 0


def ranked(turns: DataFrame) -> DataFrame:
    """turns with ``ord``, ascending as points for kind and recency descend.  Not the same
    numbers when computed again: write it."""
    order = [kind_points(F.col("kind")).desc(), F.desc("ts"), F.asc("turn_id")]
    return turns.drop(*TOKENS).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())


_POSTING = "token string, field int, block long, top_kind int, top_ts double, keys array<long>"


def _block_postings(bits: int):
    """A task that turns batches of (ord, kind, ts, tokens of each field) into one row for
    each token, field and block in it."""

    def rows(batch: pa.RecordBatch, field: int) -> pa.RecordBatch:
        words = pc.split_pattern(pc.utf8_trim(batch.column(f"f{field}"), " "), " ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ords, kind, ts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "kind", "ts"))
        real = np.flatnonzero(~np.isin(code, np.flatnonzero(coded.dictionary.to_numpy(zero_copy_only=False) == "")))
        real = real[np.lexsort((at[real], ords[row[real]], code[real]))]
        code, at, row = code[real], at[real], row[real]
        block = ords[row] >> bits
        cut = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])))) if len(code) else np.zeros(0, np.int64)
        keys = ((ords[row] - (block << bits)) << 32) + at
        most = (lambda x: np.maximum.reduceat(x[row], cut)) if len(cut) else lambda x: x[:0]
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(keys)), pa.int32()), pa.array(keys, pa.int64()))
        columns = [coded.dictionary.take(pa.array(code[cut])), pa.array(np.full(len(cut), field, np.int32)), pa.array(block[cut]), pa.array(most(kind).astype(np.int32)), pa.array(most(ts)), lists]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _POSTING.split(", ")])

    def task(batches):
        for batch in batches:
            for field in range(len(FIELDS)):
                yield rows(batch, field)

    return task


def postings(turns: DataFrame, bits: int = BITS, tokens: Callable[[Column], Column] = fold_column) -> DataFrame:
    """turns: as ``ranked`` gave them, written.  keys: turn in the block << 32 | place.  A
    block that two tasks or batches read has a row from each."""
    read = turns.select("ord", kind_points(F.col("kind")).alias("kind"), "ts", *[tokens(F.col(c)).alias(f"f{k}") for k, c in enumerate(FIELDS)])
    made = read.mapInArrow(_block_postings(bits), _POSTING)
    docs = F.array_distinct(F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")))
    # a frequent term is many partitions, a rare one is one
    dealt = made.repartition("token", F.shiftright("block", SPREAD)).sortWithinPartitions("token", "field", "block")
    return dealt.select("token", "field", "block", "top_kind", "top_ts", docs.alias("docs"), "keys")


def write(turns: DataFrame, path: str, bits: int = BITS, tokens: Callable[[Column], Column] = fold_column) -> Index:
    """Both tables below ``path``."""
    spark = turns.sparkSession
    ranked(turns).write.option("compression", "zstd").parquet(f"{path}/ranked")
    postings(spark.read.parquet(f"{path}/ranked"), bits, tokens).write.options(**PARQUET).parquet(f"{path}/postings")
    return read(spark, path, bits)


def read(spark: SparkSession, path: str, bits: int = BITS) -> Index:
    return Index(spark.read.parquet(f"{path}/ranked"), spark.read.parquet(f"{path}/postings"), bits)


def _held(index: Index, terms: list[list[str]], lo: int | None, hi: int | None) -> DataFrame:
    rows = index.postings.filter(F.col("token").isin(sorted({t for term in terms for t in term})))
    return rows if lo is None else rows.filter(F.col("block").between(lo, hi))


def matched(index: Index, terms: Sequence[str], lo: int | None = None, hi: int | None = None, folded: bool = True) -> DataFrame:
    """block, docs: the turns of each block that hold every term."""
    parts = [term_tokens(t, folded) for t in terms]
    rows = _held(index, parts, lo, hi)
    phrased = {t for term in parts if len(term) > 1 for t in term}
    single = {term[0] for term in parts if len(term) == 1}
    name = {t: k for k, t in enumerate(sorted(phrased | single))}
    pick = lambda t, f, what: F.flatten(F.collect_list(F.when((F.col("token") == t) & (F.col("field") == f), F.col(what)))).alias(f"{what}_{name[t]}_{f}")
    wanted = [pick(t, f, "docs") for t in sorted(single) for f in range(len(FIELDS))] + [pick(t, f, "keys") for t in sorted(phrased) for f in range(len(FIELDS))]
    blocks = rows.groupBy("block").agg(*wanted)

    def docs(term: list[str], f: int) -> Column:
        if len(term) == 1:
            return F.col(f"docs_{name[term[0]]}_{f}")
        back = lambda j: lambda k: k - j  # noqa: E731  a second argument would be the index
        shifted = [F.transform(F.col(f"keys_{name[t]}_{f}"), back(j)) for j, t in enumerate(term)]
        starts = reduce(F.array_intersect, shifted)
        return F.array_distinct(F.transform(starts, lambda k: F.shiftright(k, 32).cast("int")))

    each = [reduce(F.array_union, [docs(term, f) for f in range(len(FIELDS))]) for term in parts]
    return blocks.select("block", reduce(F.array_intersect, each).alias("docs")).filter(F.size("docs") > 0)


def levels(index: Index, terms: Sequence[str], now: float, folded: bool = True) -> list:
    """Of the blocks that hold all tokens: for each upper bound of kind and recency points
    (there are nine at most), best first, how many, which range, and the latest time."""
    parts = [term_tokens(t, folded) for t in terms]
    tokens = sorted({t for term in parts for t in term})
    bound = F.col("top_kind") + recency_points(F.col("top_ts"), now)
    of = lambda t, c: F.max(F.when(F.col("token") == t, c))
    blocks = _held(index, parts, None, None).groupBy("block").agg(*[of(t, bound).alias(f"b{k}") for k, t in enumerate(tokens)], *[of(t, F.col("top_ts")).alias(f"t{k}") for k, t in enumerate(tokens)])
    full = blocks.filter(reduce(lambda a, b: a & b, [F.col(f"b{k}").isNotNull() for k in range(len(tokens))]))
    least = lambda x: reduce(lambda a, b: F.when(a < b, a).otherwise(b), [F.col(f"{x}{k}") for k in range(len(tokens))])
    shown = full.select("block", least("b").alias("bound"), least("t").alias("ts"))
    found = shown.groupBy("bound").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi"), F.max("ts").alias("ts")).collect()
    return sorted(found, key=lambda r: -r["bound"])


def fetch(index: Index, found: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The turns of (block, docs)."""
    ords = found.select(F.explode(F.transform("docs", lambda d: F.shiftleft("block", index.bits) + d)).alias("ord"))
    turns = index.ranked
    if lo is not None:
        turns = turns.filter(F.col("ord").between(lo << index.bits, ((hi + 1) << index.bits) - 1))
    return turns.join(ords, "ord").drop("ord")


def candidates(index: Index, sessions: DataFrame | None, terms: Sequence[str], filters: Filters = Filters(), scan: int | None = None, folded: bool = True) -> DataFrame:
    """As search.candidates, by way of the index: all turns with every term."""
    found = fetch(index, matched(index, terms, folded=folded)) if all(term_tokens(t, folded) for t in terms) else index.ranked.drop("ord").filter(F.lit(False))
    out = (found if sessions is None else with_sessions(found, sessions)).filter(filters.predicate())
    return out.orderBy("turn_id").limit(scan) if scan else out


def top(index: Index, sessions: DataFrame | None, terms: Sequence[str], now: float, limit: int, filters: Filters = Filters(), wave: int = 64, folded: bool = True) -> tuple[DataFrame, Reads]:
    """The best ``limit`` turns, in order, as by a full ranking.  sessions: None if turns
    have their columns.  wave: blocks to read in one go at least."""
    spark, reads = index.ranked.sparkSession, Reads()
    most = TERM_POINTS * len(set(terms)) + PHRASE_POINTS
    left = levels(index, terms, now, folded) if terms and all(term_tokens(t, folded) for t in terms) else []
    reads.blocks = sum(r["n"] for r in left)
    schema = score(candidates(index, sessions, terms, filters, folded=folded), terms, now).schema
    rows: list = []
    while left:
        if len(rows) == limit and (rows[-1]["score"], rows[-1]["ts"]) > (left[0]["bound"] + most, max(r["ts"] for r in left)):
            break
        now_read = [left.pop(0)]
        while left and sum(r["n"] for r in now_read) < wave:
            now_read.append(left.pop(0))
        lo, hi = min(r["lo"] for r in now_read), max(r["hi"] for r in now_read)
        found = fetch(index, matched(index, terms, lo, hi, folded), lo, hi)
        found = (found if sessions is None else with_sessions(found, sessions)).filter(filters.predicate())
        reads.read += sum(r["n"] for r in now_read)
        own = {r["turn_id"]: r for r in (*rows, *top_turns(score(found, terms, now), limit).collect())}
        rows = sorted(own.values(), key=lambda r: (-r["score"], -r["ts"], r["session_id"].encode(), r["seq"], r["turn_id"]))[:limit]
    return spark.createDataFrame(rows, schema).orderBy(*best_first()), reads
