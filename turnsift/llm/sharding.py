"""Sharding by sampled splitters.

``shard_documents(docs, shards=8)`` draws keys weighted by size, takes quantiles as
splitters, and range-partitions the records.  Ranges that turn out overfull are sampled
again, all in one job, and subdivided, until none holds more than twice its share but for
a single key; the shard boundaries then cut the ranges at exact running sums, so the
shards' bytes differ by about one record.  The key is 40 bits of the text's hash, then 24
bits of the doc_id's: equal texts are neighbours, and a hot text still spreads over ranges.

Law ``bytes``: near-equal sizes.  Size: UTF-8 bytes of the text plus 1 (null text: 1).
The driver holds DRAWS keys and one sum for each range; it starts with MAX_RANGES at most
(records are some forty bytes, so those are small at any size).

Defined cases: null doc_id, null or empty text and repeated rows are records like
others; ties in the key are ordered by doc_id, then size; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

MIN_RANGES, MAX_RANGES, DRAWS = 32, 4096, 16


def _quantiles(keys: np.ndarray, draws: np.ndarray, parts: int) -> np.ndarray:
    keys = np.sort(np.repeat(keys, draws))
    return np.unique(keys[np.linspace(0, len(keys), parts + 1).astype(int)[1:-1]]) if len(keys) else keys


def _splitters(rows: DataFrame, parts: dict[int, tuple[int, int]], seed: int) -> dict[int, np.ndarray]:
    """For each range named in ``parts`` (its bytes, the parts wanted) quantiles of keys
    drawn in proportion to size: DRAWS a part on average."""
    wanted = rows.sparkSession.createDataFrame([(k, n * DRAWS / max(size, 1), n * DRAWS) for k, (size, n) in parts.items()], "range int, rate double, most long")
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    draws = F.least(F.floor(F.col("size") * F.col("rate") + u), F.col("most")).alias("draws")
    drawn = rows.join(F.broadcast(wanted), "range").select("range", "key", draws).filter("draws > 0").toPandas()
    return {k: _quantiles(g["key"].to_numpy(np.int64), g["draws"].to_numpy(), parts[k][1]) for k, g in drawn.groupby("range")}


def _ranged(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    def deal(batches):
        for b in batches:
            k = np.searchsorted(splits, b.column("key").to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int32())], names=[*b.schema.names, "range"])

    return rows.mapInArrow(deal, "doc_id long, size long, text_crc32 long, key long, range int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0) and grown_shard (null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).bitwiseAND(F.lit(0xFFFFFF))
    rows = scratch(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit(~0xFFFFFF)).bitwiseOR(low).alias("key"),
        ),
        "records",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = int(total or 0)
    ranges = int(np.clip(n // 20_000, MIN_RANGES, MAX_RANGES))
    splits = _splitters(rows.withColumn("range", F.lit(0)), {0: (total, ranges)}, 0).get(0, np.zeros(0, np.int64))
    for turn in itertools.count(1):
        sums = _ranged(rows, splits).groupBy("range").agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
        full = {r["range"]: r for r in sums if r["size"] > 2 * total / ranges and r["a"] < r["b"]}
        if not full:
            break
        drawn = _splitters(_ranged(rows, splits), {k: (r["size"], 1 + r["size"] * ranges // total) for k, r in full.items()}, turn)
        # on both sides of a key, which sets a hot one apart; the middle moves what no draw does
        cuts = [np.array([r["a"] + (r["b"] - r["a"] + 1) // 2 for r in full.values()], np.int64)]
        cuts += [np.concatenate((k, k + 1)) for k in drawn.values()]
        splits = np.unique(np.concatenate([splits, *cuts]))
    sums = {r["range"]: r["size"] for r in sums}
    before = np.concatenate(([0], np.cumsum([sums.get(k, 0) for k in range(len(splits) + 1)])))[:-1]
    spark = docs.sparkSession
    bases = spark.createDataFrame([(k, int(b)) for k, b in enumerate(before)], "range int, base long")
    w = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    placed = _ranged(rows, splits).join(F.broadcast(bases), "range")
    placed = placed.withColumn("rn", F.row_number().over(w)).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.expr(f"(2 * (base + upto) - size) * {shards} div {max(2 * total, 1)}")
    placed = scratch(placed.withColumn("shard", F.least(F.lit(shards - 1), middle).cast("int")).drop("base", "upto", "key"), "placed")
    count = placed.groupBy("shard", "range").agg(F.min("rn").alias("low"), F.count(F.lit(1)).alias("n")).orderBy("shard", "range").collect()
    offsets, next_slot = [], {}
    for r in count:
        offsets.append((r["shard"], r["range"], next_slot.get(r["shard"], 0) - r["low"]))
        next_slot[r["shard"]] = next_slot.get(r["shard"], 0) + r["n"]
    offsets = spark.createDataFrame(offsets, "shard int, range int, shift long")
    out = placed.join(F.broadcast(offsets), ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rn") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
