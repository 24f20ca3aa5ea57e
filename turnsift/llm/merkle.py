"""Merkle manifest of a dataset in an external-memory node store.

A document's leaf is the SHA-256 of its fields, a source's leaves in order of doc_id are
reduced three at a time to its subroot, and the subroots in order of source to the root.
The store is Parquet, partitioned by level, and built in generations:

* leaves are dealt into sorted runs by ranges of (source, doc_id, leaf); counts of each
  run and source turn the place in a run into a coordinate (tree, position);
* a block is FAN**SPAN consecutive nodes of one tree.  A task streams through whole blocks
  in order, feeds each level from the one before, and writes all of them by level; the
  uppermost level is what the next generation reads;
* proofs are merge-scans: for each block the path above it, its stored levels and its
  leaves meet in order of (tree, block, level, position), from the top generation down.

No block is larger than FAN**SPAN, so a source may hold any share of the rows, and no task
holds more than a block.  The driver sees three counts, a row for each run and the root.

Defined cases: a null field is ``-``; a null source is a tree of its own, before all
others; null doc_id orders first and is never tampered with; rows with one doc_id are
ordered by their leaf, and rows equal in all fields are leaves of their own, whose order
cannot matter; long texts are hashed whole, on the JVM; other columns are ignored; an
empty table has no root and an empty manifest.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, partitions, scratch, small_batches

FAN, SPAN = 3, 6
RUN_ROWS = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """leaves: tree, pos, n, digest, doc_id, bent (the tampered leaf, or the leaf).
    levels, top: stores of each generation (level, tree, pos, n, digest, root): of the
    sources' trees and of the tree over them.  root: hex, or None without documents."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def leaf_digest(fields: list[Column]) -> Column:
    shown = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in fields)]
    return F.unhex(F.sha2(F.concat(*shown).cast("binary"), 256))


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, digest, bent: the leaf with line feeds deleted from the text, for
    documents whose decimal doc_id has an even CRC-32; the leaf itself for others."""
    named = {c: column(c).cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    bends = (F.crc32(named["doc_id"].cast("string")) % 2 == 0) & named["text"].contains("\n")
    cut = named | {"text": F.translate(named["text"], "\n", "")}
    whole, bent = leaf_digest(list(named.values())), leaf_digest(list(cut.values()))
    return docs.select(named["doc_id"].alias("doc_id"), named["source"].alias("source"), whole.alias("digest"), F.when(bends, bent).alias("bent"))


def _runs(df: DataFrame, by: list[str], runs: int) -> DataFrame:
    """df in sorted runs; _at counts rows within a run, whose number is in its high bits."""
    ranged = df.repartitionByRange(runs, *by).sortWithinPartitions(*by)
    return scratch(ranged.withColumn("_at", F.monotonically_increasing_id()), "runs").withColumn("_run", F.shiftright("_at", 33))


def _placed(spark: SparkSession, leaves: DataFrame, n: int) -> DataFrame:
    """leaves with their coordinate: tree (the rank of the source), pos, and the tree's n."""
    runs = _runs(leaves, ["source", "doc_id", "digest", "_uid"], max(partitions(spark), n // RUN_ROWS))
    starts = scratch(runs.groupBy("source", "_run").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "starts")
    sizes = starts.groupBy("source").agg(F.sum("_n").alias("n"))
    ranked = _runs(sizes, ["source"], partitions(spark))
    counts = ranked.groupBy("_run").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("_run").collect()
    shifts, before = [], 0
    for c in counts:
        shifts.append((c["_run"], before - c["first"]))
        before += c["n"]
    trees = ranked.join(F.broadcast(spark.createDataFrame(shifts, "_run long, _by long")), "_run").select(F.col("source").alias("_s"), (F.col("_at") + F.col("_by")).alias("tree"), "n")
    earlier = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    moved = starts.withColumn("_by", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
    moved = moved.join(trees, F.col("source").eqNullSafe(F.col("_s"))).select("_s", F.col("_run").alias("_r"), "_by", "tree", "n")
    placed = runs.join(moved, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_run") == F.col("_r")))
    return placed.select("tree", (F.col("_at") + F.col("_by")).alias("pos"), "n", "digest", "doc_id", F.coalesce("bent", "digest").alias("bent"))


# ---------------------------------------------------------------- levels


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _reduced(nodes: list[str]) -> list[str]:
    return [_digest("".join(nodes[k : k + FAN])) for k in range(0, len(nodes), FAN)]


def _blocks(batches, *names):
    """Whole blocks of rows sorted by (tree, block): lists of dicts with ``names``."""
    held, at = [], None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in names]
        keys = zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True)
        for key, *row in zip(keys, *cols, strict=True):
            if key != at:
                if held:
                    yield *at, held
                held, at = [], key
            held.append(row)
    if held:
        yield *at, held


_NODE = "tree long, pos long, n long, digest binary, root boolean, level int"


def _climb(base: int):
    """A task that makes the levels base to base + SPAN of each block."""

    def task(batches):
        out: list[tuple] = []
        for tree, block, rows in _blocks(batches, "n", "digest"):
            n, nodes = rows[0][0], [d.hex() for _, d in rows]
            height = min(SPAN, _height(n))
            for up in range(height + 1):
                first = block * FAN ** (SPAN - up)
                out += [(tree, first + k, n, bytes.fromhex(d), n == 1, base + up) for k, d in enumerate(nodes)]
                nodes, n = _reduced(nodes), -(-n // FAN)
            if len(out) > 20_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["tree", "pos", "n", "digest", "root", "level"])

    return task


def _grow(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The stores of all generations over leaves (tree, pos, n, digest); most: largest n."""
    stores, base = [], 0
    while True:
        dealt = leaves.select("tree", F.floor(F.col("pos") / FAN**SPAN).alias("block"), "pos", "n", "digest")
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        stores.append(scratch(dealt.mapInArrow(_climb(base), _NODE), "levels", by=("level",)))
        most, base = -(-most // FAN**SPAN), base + SPAN
        if most <= 1:
            return stores
        leaves = stores[-1].filter((F.col("level") == base) & ~F.col("root"))


def build_manifest(docs: DataFrame) -> Manifest:
    spark = docs.sparkSession
    small_batches(spark)
    leaves = scratch(tampered_leaves(docs).withColumn("_uid", F.monotonically_increasing_id()), "leaves")
    placed = scratch(_placed(spark, leaves, leaves.count()), "placed")
    most, sources = placed.agg(F.max("n"), F.max("tree") + 1).first()
    if not most:
        return Manifest(placed, [], [], None)
    levels = _grow(placed, most)
    subroots = _roots(levels).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sources).cast("long").alias("n"), "digest")
    top = _grow(subroots, sources)
    return Manifest(placed, levels, top, bytes(_roots(top).first()["digest"]).hex())


def _roots(stores: list[DataFrame]) -> DataFrame:
    out = None
    for gen, store in enumerate(stores):
        some = store.filter("root").select("tree", "digest", F.lit(gen).alias("gen"))
        out = some if out is None else out.unionByName(some)
    return out


# ---------------------------------------------------------------- proofs

_PATH = "tree long, pos long, path string, subroot binary"
_PROOF = "doc_id long, tree long, pos long, leaf string, subroot string, proof string, proof_sha256 string, folded_root string"


def _paths(base: int, final: bool):
    """A task that merges, for each block, the path above it, its stored levels from the
    upper one down, and its lowest nodes.  A path has a step ``left,right`` for each level:
    the siblings before and behind, end to end."""

    def steps(levels: list[list[str]], above: list[str]) -> list[list[str]]:
        """The path of each of the lowest nodes."""
        paths = [above]
        for nodes in reversed(levels):
            grown = []
            for k in range(len(nodes)):
                a = k // FAN * FAN
                grown.append([f"{''.join(nodes[a:k])},{''.join(nodes[k + 1 : a + FAN])}", *paths[k // FAN]])
            paths = grown
        return paths

    def folded(digest: str, path: list[str]) -> str:
        for step in path:
            left, right = step.split(",")
            digest = _digest(left + digest + right)
        return digest

    def task(batches):
        out: list[tuple] = []
        for tree, _, rows in _blocks(batches, "level", "pos", "n", "digest", "path", "doc_id", "bent"):
            (_, _, _, subroot, above, _, _), rows = rows[0], rows[1:]
            levels: list[list] = [[] for _ in range(SPAN)]
            for row in rows:
                levels[row[0] - base].append(row)
            height = min(SPAN, _height(levels[0][0][2]))
            paths = steps([[r[3].hex() for r in level] for level in levels[:height]], above.split(";") if above else [])
            for (_, pos, _, digest, _, doc_id, bent), path in zip(levels[0], paths, strict=True):
                if final:
                    proof = "".join(path).replace(",", "")
                    out.append((doc_id, tree, pos, digest.hex(), subroot.hex(), proof, _digest(proof), folded(bent.hex(), path)))
                else:
                    out.append((tree, pos, ";".join(path), subroot))
            if len(out) > 2_000:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out):
        ints, text = pa.int64(), pa.string()
        kinds = [ints, ints, ints, text, text, text, text, text] if final else [ints, ints, text, pa.binary()]
        names = [f.split()[0] for f in (_PROOF if final else _PATH).split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return task


def _descend(stores: list[DataFrame], heads: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """Paths of the lowest nodes of all trees, or with ``leaves`` their proofs.  heads: the
    root of each tree (tree, gen, path, subroot), with the path above it."""
    below = None
    for gen in reversed(range(len(stores))):
        base, final = gen * SPAN, gen == 0 and leaves is not None
        above = heads.filter(F.col("gen") == gen).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if below is not None:
            above = above.unionByName(below.select("tree", F.col("pos").alias("block"), "path", "subroot"))
        none, no_path = F.lit(None).cast("long"), F.lit(None).cast("string")
        above = above.select("tree", "block", F.lit(base + SPAN).alias("level"), none.alias("pos"), none.alias("n"), F.col("subroot").alias("digest"), "path", none.alias("doc_id"), F.lit(None).cast("binary").alias("bent"))
        inner = stores[gen].filter((F.col("level") >= base + int(final)) & (F.col("level") < base + SPAN) & ((F.col("level") == base) | ~F.col("root")))
        width = F.element_at(F.array(*[F.lit(FAN ** (SPAN - k)) for k in range(SPAN)]), F.col("level") - base + 1)
        inner = inner.select("tree", F.floor(F.col("pos") / width).alias("block"), "level", "pos", "n", "digest", no_path.alias("path"), none.alias("doc_id"), F.lit(None).cast("binary").alias("bent"))
        if final:
            inner = inner.unionByName(leaves.select("tree", F.floor(F.col("pos") / FAN**SPAN).alias("block"), F.lit(0).alias("level"), "pos", "n", "digest", no_path.alias("path"), "doc_id", "bent"))
        met = above.unionByName(inner).repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("level"), "pos")
        below = met.mapInArrow(_paths(base, final), _PROOF if final else _PATH)
        if gen:
            below = scratch(below, "paths")
    return below


def proofs(manifest: Manifest) -> DataFrame:
    """For each leaf its coordinate (tree, pos), its proof (siblings level by level, left
    to right, as hex) with its digest, and the root folded from the tampered leaf."""
    if manifest.root is None:
        return manifest.leaves.sparkSession.createDataFrame([], _PROOF)
    whole = _roots(manifest.top).select("tree", "gen", F.lit("").alias("path"), F.col("digest").alias("subroot"))
    upper = scratch(_descend(manifest.top, whole), "paths").select(F.col("pos").alias("tree"), "path")
    heads = scratch(_roots(manifest.levels).join(upper, "tree").select("tree", "gen", "path", F.col("digest").alias("subroot")), "heads")
    return _descend(manifest.levels, heads, manifest.leaves)


def prove_documents(docs: DataFrame) -> DataFrame:
    """The manifest of docs and the proof of each document, checked after tampering."""
    manifest = build_manifest(docs)
    root = F.lit(manifest.root).cast("string")
    return proofs(manifest).withColumn("root", root).withColumn("verified", F.col("folded_root") == root)
