"""Helpers that several corpus operators use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalar import let
from barloom.functions.session import durable, shared_folder

__all__ = ["ascii_lower", "bodies", "connected_components", "durable", "fresh_name", "let", "offsets", "shared_folder", "table", "wide_hash"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bodies(texts: pa.Array, rows: int = 256, size: int = 1 << 22) -> Iterator[tuple[int, list[bytes | None]]]:
    """The UTF-8 bytes of a column of texts in short lists, each with its first row: of ``rows`` texts, or
    fewer if they are over ``size`` bytes together. A batch's texts are never copied out all at once."""
    raw = texts.cast(pa.binary())  # the same buffers
    start, held, total = 0, [], 0
    for k in range(len(raw)):
        held.append(raw[k].as_py())
        total += len(held[-1] or b"")
        if len(held) >= rows or total >= size:
            yield start, held
            start, held, total = k + 1, [], 0
    if held:
        yield start, held


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; ``lower`` is the quick way where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(value: Column) -> Column:
    """128 bits of two differently seeded hashes: texts that differ don't meet in one value."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b"))


def offsets(sizes: Column, block: int = 128) -> Column:
    """The running total before each element of an array of whole numbers. As arrays grow by being copied,
    totals run inside blocks first and over the blocks then."""
    none = F.array().cast("array<int>")

    def running(xs: Column) -> Column:
        step = lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["out"], F.array(s["total"])).alias("out"))
        return F.aggregate(xs, F.struct(F.lit(0).alias("total"), none.alias("out")), step)

    def whole(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: running(F.slice(xs, b * block + 1, block)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, lambda b: b["total"]))["out"], lambda b, before: F.transform(b["out"], lambda x: x + before))))

    return let(sizes, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b); root is the least node reachable.

    Alternating large-star and small-star steps: every node only ever looks at the minimum of its
    neighbours, which is a partial aggregate, so no neighbour list is gathered. Each round's edges
    go to the checkpoint folder. Self-loops keep isolated nodes; nulls are dropped.
    """
    edges = durable(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a or a = m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = durable(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = state(edges)
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
