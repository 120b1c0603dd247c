"""Chat formatting of preferences.

A pair has a chosen and a rejected conversation. The turns that both begin with are rendered once, as
the prompt; what follows in each is its completion, with the ranges of it that a model learns from:
the texts of assistant turns and the end marks after them.

A turn is rendered as ``<|role|>``, a line break, its text, ``<|end|>`` and a line break. ``<|`` inside
texts and roles becomes ``< |``, so that no text can open or close a turn.

Defined cases: a null text is an empty one and a null role is ``unknown``; turns are in order of turn,
role and text, null turns first, and repeated rows stay repeated; a pair with one side missing has an
empty conversation there; pairs with equal sides have all turns in the prompt and empty completions;
rows without an id belong to no conversation and are left out; empty tables give an empty result;
other columns are ignored. ``swapped_answers`` finds neighbours by the lowest bit of the id, so ids have to
be whole numbers there; ``format_pairs`` takes ids of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import offsets

OPEN, END = "<|", "<|end|>\n"


def conversations(turns: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(id, turns) with the turns of each conversation in order; a conversation is one row from here on."""
    clean = lambda c, none: F.replace(F.coalesce(F.col(c).cast("string"), F.lit(none)), F.lit(OPEN), F.lit("< |"))
    rows = turns.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.struct(F.col("turn"), clean("role", "unknown").alias("role"), clean("text", "").alias("text")).alias("t"))
    ordered = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(one: Column, other: Column) -> Column:
    """How many turns both begin with."""
    zipped = F.arrays_zip(one.alias("a"), other.alias("b"))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(s: Column, p: Column) -> Column:
        on = s["on"] & p["a"].eqNullSafe(p["b"])
        return F.struct((s["n"] + on.cast("int")).alias("n"), on.alias("on"))

    return F.aggregate(zipped, start, step, lambda s: s["n"])


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def learnt(turns: Column, role: str = "assistant") -> Column:
    """start:end of the ranges of ``rendered(turns)`` to learn from, in code points, ends exclusive, comma-joined."""
    sizes = F.transform(turns, lambda t: F.char_length(_head(t)) + F.char_length(t["text"]) + len(END))

    def spanned(t: Column, before: Column) -> Column:
        begin = before + F.char_length(_head(t))
        stop = begin + F.char_length(t["text"]) + (len(END) - 1)
        return F.when(t["role"] == role, F.concat_ws(":", begin.cast("string"), stop.cast("string")))

    return F.array_join(F.array_compact(F.zip_with(turns, offsets(sizes), spanned)), ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask) of (pair_id, chosen, rejected),
    two arrays of turns (role, text)."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    both = both.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    return both.select(
        "pair_id", "n_common", rendered(F.slice("chosen", 1, F.col("n_common"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"), learnt(rest("chosen")).alias("chosen_mask"), rendered(rest("rejected")).alias("rejected"), learnt(rest("rejected")).alias("rejected_mask"),
    )


def paired(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs from two tables of turns (pair_id, turn, role, text)."""
    one = conversations(chosen, "pair_id").toDF("pair_id", "chosen")
    return one.join(conversations(rejected, "pair_id").toDF("pair_id", "rejected"), "pair_id", "full")


def swapped_answers(turns: DataFrame) -> DataFrame:
    """Pairs from conversations alone: each conversation is chosen over itself with its last assistant
    text replaced by that of the conversation whose id differs in the lowest bit (empty if there is none)."""
    talks = conversations(turns)
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()))
    talks = talks.withColumn("last", last).withColumn("answer", F.get("turns", F.col("last"))["text"])
    other = talks.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("answer").alias("other"))
    changed = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("last"), F.coalesce("other", F.lit(""))).otherwise(t["text"]).alias("text")))
    return talks.join(other, "id", "left").select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), changed.alias("rejected"))


def report(turns: DataFrame) -> DataFrame:
    """The formatted pairs of ``swapped_answers``: a row per conversation."""
    return format_pairs(swapped_answers(turns))
