"""Line dedup: lines that many documents share go from all of them.

Lines are keyed by what is left after stripping and lower-casing, the distinct keys of a document
are hashed to 128 bits and exploded, and documents are counted per hash. Every row is a document of
its own. Flags come back by position; texts themselves are shuffled once, to meet their flags.

Defined cases: a null or empty text is one empty line; empty keys are never dropped with
``min_length`` of 1 or more; rows that repeat count as documents each and lose the same lines; an
empty table gives an empty result; other columns are kept by ``dedup`` (with clashing names as they
are) and ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import ascii_lower, durable, fresh_name, wide_hash

MIN_DOCUMENTS, MIN_LENGTH = 10, 1
_SPACE = " \t\n\u000b\f\r"


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda x: F.btrim(x, F.lit(_SPACE)))


def _hashed(keys: Column, min_length: int) -> Column:
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_length, wide_hash(k)))


def frequent_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(line) hashes of the keys that at least ``min_documents`` documents hold; counted before the shuffle."""
    hashes = F.array_compact(_hashed(F.array_distinct(line_keys(F.col("text"))), min_length))  # texts are told apart by hashing, structs one by one
    counts = documents.select(F.explode(hashes).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    return durable(counts.where(F.col("n") >= min_documents).select("line"))


def drop_flags(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, text_hash, flags) of the documents that lose lines: a flag per line, in order.

    A line is sent as its hash and position. Flags depend on the text alone, so rows that repeat
    share theirs.
    """
    frequent = frequent_lines(documents, min_documents, min_length).withColumn("shared", F.lit(True))
    named = documents.select("doc_id", "text", wide_hash(F.col("text")).alias("text_hash"))  # before lines are dealt out, once a text
    lines = named.select("doc_id", "text_hash", F.posexplode(_hashed(line_keys(F.col("text")), min_length)).alias("at", "line"))
    alone = F.struct(F.xxhash64("doc_id", "at").alias("a"), F.xxhash64(F.lit("short"), "doc_id", "at").alias("b"))  # short lines don't meet in one null key
    lines = lines.withColumn("line", F.coalesce("line", alone))
    marked = lines.join(frequent, "line", "left").select("doc_id", "text_hash", (F.col("at") * 2 + F.coalesce("shared", F.lit(False)).cast("int")).alias("mark"))
    sets = marked.groupBy("doc_id", "text_hash").agg(F.collect_set("mark").alias("marks"), F.max(F.col("mark") % 2).alias("some"))
    return durable(sets.where("some = 1").select("doc_id", "text_hash", F.transform(F.array_sort("marks"), lambda m: m % 2 == 1).alias("flags")))


def _flagged(documents: DataFrame, min_documents: int, min_length: int) -> tuple[DataFrame, str]:
    """``documents`` with the flags of their lines in one more column (null: no line goes), and its name."""
    flags, hash_, id_ = (fresh_name(documents, x) for x in ("flags", "text_hash", "flag_id"))
    right = drop_flags(documents, min_documents, min_length).toDF(id_, hash_, flags)
    left = documents.withColumn(fresh_name(documents, "own_hash"), wide_hash(F.col("text")))
    own = left.columns[-1]
    return left.join(right, left["doc_id"].eqNullSafe(right[id_]) & (left[own] == right[hash_]), "left").drop(own, hash_, id_), flags


def _kept(text: Column, flags: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.when(flags.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.get(flags, i)), "\n"))


def dedup(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH) -> DataFrame:
    """``documents`` without the lines; a null text stays null."""
    out, flags = _flagged(documents, min_documents, min_length)
    return out.withColumn("text", F.when(F.col("text").isNotNull(), _kept(F.col("text"), F.col(flags)))).select(documents.columns)


def report(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    out, flags = _flagged(documents.select("doc_id", "text"), min_documents, min_length)
    text, gone = F.coalesce("text", F.lit("")), F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0))
    return out.select(
        "doc_id",
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col(flags).isNull(), 0).otherwise(gone).cast("long").alias("n_dropped"),
        F.sha2(_kept(F.col("text"), F.col(flags)), 256).alias("kept_sha256"),
    )
