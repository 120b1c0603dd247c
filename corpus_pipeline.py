"""The corpus pipeline: each stage works on all that the one before it kept.

Between stages the documents are written as Parquet in the folder that the cluster shares, as rows of
``documents``; the last stage adds the shard of each. What a stage has read is deleted when its result is
written, so two copies of the documents exist at most, and one is left for the result to be read from.

Defined cases, stage by stage: null, empty and very long texts are scored like any other, and null or
repeated ids change nothing (quality); rows whose texts link are one group whatever their ids, and unlinked
rows stay, null ids included (near-dedup); a text without words is clean (decontamination); a null source
is a source of its own (mixing); a null text has no bytes (sharding). An empty table gives an empty result
with the same columns, and columns beyond those of ``documents`` pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.session import fresh_folder, remove_folder
from barloom.llm import decontaminate, mixing, quality, sharding, simhash
from barloom.llm.shared import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labelled rows of the whole table."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored, score = quality.with_score(docs, model)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to twice, as their weights ask for."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and virtual slot, by a map that evens out bytes."""
    slots = sharding.slot_map(sharding.slot_totals(sharding.sizes(docs)))
    return sharding.place_rows(docs, slots)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

ORACLE_SQL = None  # a fitted model decides the first stage; tests/llm holds the run against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
