"""Preference formatting of paired conversations, all in DataFrame functions.

``format_pairs(pairs)`` takes ``pair_id``, ``chosen`` and ``rejected``: arrays of
struct<role, text>.  The longest common turn prefix is rendered once as the prompt; the
rest of each conversation is its completion, with a mask of the spans to train on (the
text of assistant turns and their end mark, as code points of the completion).

``pairs_from_turns(turns)`` makes pairs of a table (conv_id, turn, role, text): chosen
is the conversation itself; in rejected the text of its last assistant turn is that of
the next conversation (by conv_id, the last one: the first) that has one.

Defined cases: null roles and texts count as empty; equal conversations have an empty
completion on both sides; without a common turn the prompt is empty; a conversation
without an assistant turn makes no pair; turns are ordered by turn, role, text, so
ties and repeated rows have a fixed order; turns with a null conv_id belong to no
conversation and make no pair, while a null pair_id is formatted like any other; other
columns are ignored; empty in, empty out.  No text is cut: a conversation is one row, so
its turns, however long, have to fit into a cell together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, scratch

#: Keys of one range while conversations are put in order (8 bytes each).
RANGE_KEYS = 1_000_000
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _render(turn):
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _completion(turns):
    """Struct of text and mask: one walk over the turns, carrying the length so far."""
    done = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))

    def step(acc, turn):
        begin = acc["at"] + F.length(turn["role"]) + len(OPEN) + len(MIDDLE)
        stop = begin + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("stop")))
        mask = F.when(turn["role"] == "assistant", F.concat(acc["mask"], span)).otherwise(acc["mask"])
        return F.struct(stop.cast("int").alias("at"), mask.alias("mask"))

    return F.array_join(F.transform(turns, _render), ""), F.aggregate(turns, done, step)["mask"]


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    both = pairs.select("pair_id", clean("chosen").alias("_a"), clean("rejected").alias("_b"))
    short = F.least(F.size("_a"), F.size("_b"))
    differ = F.filter(F.sequence(F.lit(1), short), lambda i: F.element_at("_a", i) != F.element_at("_b", i))
    n = F.when(short == 0, 0).otherwise(F.coalesce(F.get(differ, 0) - 1, short))
    both = both.withColumn("_n", n.cast("int"))
    out = both.select("pair_id", F.col("_n").alias("n_prompt_turns"), F.slice("_a", 1, F.col("_n")).alias("_p"), F.slice("_a", F.col("_n") + 1, F.size("_a")).alias("_a"), F.slice("_b", F.col("_n") + 1, F.size("_b")).alias("_b"))
    chosen, chosen_mask = _completion(F.col("_a"))
    rejected, rejected_mask = _completion(F.col("_b"))
    return out.select("pair_id", "n_prompt_turns", F.array_join(F.transform("_p", _render), "").alias("prompt"), chosen.alias("chosen"), chosen_mask.alias("chosen_mask"), rejected.alias("rejected"), rejected_mask.alias("rejected_mask"))


def next_in_order(rows: DataFrame, key: str, value: str, ranges: int | None = None) -> DataFrame:
    """(key, value) -> (key, following): the value of the next key, the first after the
    last.  Keys are unique and not null.  Only keys are put in order, in ranges of about
    RANGE_KEYS that Spark samples; each range's first key is shared, and the values come
    back by a join on the key, so no task holds a range's values.  ``rows`` is read twice."""
    spark = rows.sparkSession
    ranges = ranges or max(partitions(spark), -(-rows.count() // RANGE_KEYS))
    # a range is a partition of this written table, whatever is read later
    keys = scratch(rows.select(F.col(key).alias("k")).repartitionByRange(ranges, "k").withColumn("g", F.spark_partition_id()), "keys")
    heads = keys.groupBy("g").agg(F.min("k").alias("h"))  # a row for each range
    every = Window.orderBy("g")
    heads = heads.select("g", F.coalesce(F.lead("h").over(every), F.min("h").over(Window.partitionBy())).alias("head"))
    after = F.lead("k").over(Window.partitionBy("g").orderBy("k"))
    order = keys.withColumn("n", after).join(F.broadcast(heads), "g").select(F.col("k").alias("_k"), F.coalesce("n", "head").alias("_n"))
    values = rows.select(F.col(key).alias("_n"), F.col(value).alias("following"))
    return order.join(values, "_n").select(F.col("_k").alias(key), "following")


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant"))
    convs = convs.withColumn("at", last).filter("at is not null").withColumn("answer", F.element_at("turns", F.col("at"))["text"])
    convs = scratch(convs, "conversations")
    convs = convs.join(next_in_order(convs, "conv_id", "answer"), "conv_id")
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    chosen = F.transform("turns", plain)
    rejected = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("at"), F.col("following")).otherwise(t["text"]).alias("text")))
    return convs.select(F.col("conv_id").alias("pair_id"), chosen.alias("chosen"), rejected.alias("rejected"))
