"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and
returns the columns of documents; the last returns the packed pieces.

* toxicity       documents that the classifier chain rejects go
* near_dups      of each group linked at 80 % of five-word shingles, the document with
                 the least doc_id stays (rows equal in doc_id and text are one document;
                 rows with a null or shared doc_id and other texts are not)
* decontaminate  documents that hold a ten-word window of a benchmark item go
* pii            spans of personal data become [kind]; n_chars follows
* pack           token pieces in sequences of 1024
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnsift.llm import pii
from turnsift.llm.common import NULL_ID, column, scratch, scratch_scope
from turnsift.llm.decontaminate import decontaminate
from turnsift.llm.jaccard_join import link_documents
from turnsift.llm.packing import pack_documents
from turnsift.llm.queries import TOXIC, tokenizer_files
from turnsift.llm.toxicity import score, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(docs: DataFrame):
    """docs with every column but doc_id and text under a name of our own, so that no
    name of the caller's meets one of an operator's; and the way back."""
    own = {c: c if c in ("doc_id", "text") else f"x{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[column(c).alias(x) for c, x in own.items()]), lambda df: df.select(*[F.col(x).alias(c) for c, x in own.items()])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _plain(docs)
    scored = score(plain, train(plain, _table(spark, sf_dir, "labels")), carry=tuple(plain.columns))
    return back(scored.filter(F.col("p_toxic") < TOXIC))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _plain(docs)
    # a row's identity is doc_id and text: a shared or null doc_id links nothing; a second
    # hash keeps rows apart whose first one collides
    text = F.coalesce("text", F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    keyed = plain.withColumn("_did", did).withColumn("_row", F.xxhash64("_did", text)).withColumn("_other", F.xxhash64(F.lit(7), text, "_did"))
    linked = link_documents(keyed.select(F.col("_row").alias("doc_id"), "text"), words=5, num=80, den=100)
    rows = keyed.select("_row", "_other", "_did").distinct()
    groups = linked.select(F.col("doc_id").alias("_row"), "component_id").distinct().join(rows, "_row")
    least = groups.groupBy("component_id").agg(F.min(F.struct("_did", "_row"))["_row"].alias("_row")).select("_row")
    stay = rows.join(least, "_row", "left_semi").select("_row", "_other")
    # repeated rows meet after a partial aggregate, so a hot one is one row a partition
    hashed = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in plain.schema]
    one = keyed.groupBy("_row", "_other").agg(F.min_by(F.struct(*plain.columns), F.xxhash64(*hashed)).alias("_all"))
    return back(one.join(stay, ["_row", "_other"], "left_semi").select("_all.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = _plain(docs)
    return back(decontaminate(plain, _table(spark, sf_dir, "benchmark"), window=10, carry=tuple(plain.columns)).filter("n_hit = 0"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact_personal_data(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, capacity=1024, end_id=2, **tokenizer_files())


STAGES = [("toxicity", toxicity), ("near_dups", near_dups), ("decontaminate", decontaminated), ("pii", redacted), ("pack", packed)]

#: The classifier, the tokenizer and the components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_scope(spark, keep=1):
            docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
