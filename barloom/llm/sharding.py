"""Sharding by fixed virtual slots.

Records hash into thousands of slots, bytes are added up per slot, and a small versioned table says
which shard holds which slot. Rebalancing writes a new version that moves as few slots as it can;
records never move on their own.

Rows that repeat id and text are one group with a count, added up before any shuffle. Groups are cut into
runs of at most ``RUN`` rows, and each run hashes to a slot of its own; so a third of all rows may be the
same row and still spread evenly, and no task orders or writes more than its share.

Defined cases: a null text counts no bytes; null ids are placed by their text; equal rows are spread over
slots by their number; an empty table gives an empty result and a map of empty slots; other columns are
ignored, and those named like the ones ``place_rows`` adds keep their names, with an underscore at the new.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.shared import durable, fresh_name, shared_folder

SLOTS, SHARDS, OVERHEAD = 4096, 24, 8
RUN = 64  #: equal rows in a run: they share a slot
TOLERANCE = 0.001  #: how far the heaviest shard may be over the mean before slots move
MAP_SCHEMA = "version int, vslot int, shard int, slot_bytes long, slot_rows long, first_slot long"


def sizes(documents: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row; the text itself goes no further."""
    return _measured(documents).withColumn("vslot", slot_of(n_slots, F.col("doc_id"), F.col("text_crc32"), F.lit(0)))


def _measured(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))


def runs(documents: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, run, rows, vslot): a row per run of equal rows, nearly always of one."""
    groups = _measured(documents).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("all_rows"))
    last = F.floor((F.col("all_rows") - 1) / RUN)
    cut = groups.select("doc_id", "size", "text_crc32", "all_rows", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("run"))
    return cut.select("doc_id", "size", "text_crc32", "run", F.least(F.lit(RUN), F.col("all_rows") - F.col("run") * RUN).alias("rows"), slot_of(n_slots, F.col("doc_id"), F.col("text_crc32"), F.col("run")).alias("vslot"))


def slot_of(n_slots: int, doc_id: Column, crc: Column, run: Column) -> Column:
    """The virtual slot of a run of rows; it never depends on the number of shards."""
    return F.pmod(F.xxhash64(doc_id, crc, run.cast("long")), F.lit(n_slots)).cast("int")


def slot_totals(sized: DataFrame) -> DataFrame:
    """(vslot, slot_bytes, slot_rows) of ``sizes`` or ``runs``: a row per slot that has rows, so never more than n_slots."""
    rows = F.col("rows") if "rows" in sized.columns else F.lit(1)
    return sized.groupBy("vslot").agg(F.sum(F.col("size") * rows).alias("slot_bytes"), F.sum(rows).alias("slot_rows"))


def place(loads: dict[int, tuple[int, int]], shards: int, n_slots: int) -> dict[int, int]:
    """Slot to shard: the largest slot left goes to the lightest shard."""
    heap = [(0, 0, s) for s in range(shards)]
    shard_of = {}
    for slot in sorted(range(n_slots), key=lambda v: (-loads.get(v, (0, 0))[0], v)):
        size, rows, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        more = loads.get(slot, (0, 0))
        heapq.heappush(heap, (size + more[0], rows + more[1], shard))
    return shard_of


def move(shard_of: dict[int, int], loads: dict[int, tuple[int, int]], shards: int, tolerance: float) -> dict[int, int]:
    """``shard_of`` for ``shards`` shards, moving slots from the heaviest to the lightest shard while
    the heaviest is over the mean by more than ``tolerance`` and a move helps. Slots of removed shards go first."""
    out = dict(shard_of)
    size = lambda v: loads.get(v, (0, 0))[0]
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    homeless = [v for v, s in out.items() if s >= shards]
    for v, s in out.items():
        if s < shards:
            load[s] += size(v)
            held[s].add(v)
    for v in sorted(homeless, key=lambda v: (-size(v), v)):
        s = min(range(shards), key=lambda s: (load[s], s))
        out[v] = s
        load[s] += size(v)
        held[s].add(v)
    mean = sum(load) / shards
    for _ in range(len(out)):
        top, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        if load[top] <= mean * (1 + tolerance):
            break
        gap = load[top] - load[low]
        fits = [v for v in held[top] if 0 < size(v) < gap]
        if not fits:
            break
        v = min(fits, key=lambda v: (abs(size(v) - gap / 2), v))
        held[top].remove(v)
        held[low].add(v)
        out[v] = low
        load[top] -= size(v)
        load[low] += size(v)
    return out


def as_map(spark: SparkSession, shard_of: dict[int, int], loads: dict[int, tuple[int, int]], version: int) -> DataFrame:
    """The map as a table; first_slot counts the rows of the shard in the slots before this one."""
    begun: dict[int, int] = {}
    rows = []
    for v in sorted(shard_of):
        s, (size, n) = shard_of[v], loads.get(v, (0, 0))
        rows.append((version, v, s, size, n, begun.get(s, 0)))
        begun[s] = begun.get(s, 0) + n
    return spark.createDataFrame(rows, MAP_SCHEMA)


def dealt_map(spark: SparkSession, shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
    """Version 0 of the map, before anything is known: slots dealt in turn."""
    return as_map(spark, {v: v % shards for v in range(n_slots)}, {}, 0)


def slot_map(totals: DataFrame, shards: int = SHARDS, n_slots: int = SLOTS) -> DataFrame:
    """Version 1 of the map. Only the n_slots totals come to the driver."""
    loads = _loads(totals)
    return as_map(totals.sparkSession, place(loads, shards, n_slots), loads, 1)


def _loads(totals: DataFrame) -> dict[int, tuple[int, int]]:
    return {r.vslot: (r.slot_bytes, r.slot_rows) for r in totals.collect()}


def rebalance(old: DataFrame, totals: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The next version of ``old`` for new totals or another number of shards."""
    rows = old.collect()
    loads = _loads(totals)
    shard_of = move({r.vslot: r.shard for r in rows}, loads, shards, tolerance)
    return as_map(old.sparkSession, shard_of, loads, max(r.version for r in rows) + 1)


def save_map(slots: DataFrame, path: str) -> None:
    """Adds a version to the stored maps; earlier versions stay readable."""
    slots.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    newest = version if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == newest).select(*(c.split()[0] for c in MAP_SCHEMA.split(", ")))


def _same_slots(slots: DataFrame, n_slots: int) -> None:
    held = slots.count()
    if held != n_slots:
        raise ValueError(f"the map has {held} slots and {n_slots} are asked for: rows of the others would be lost")


def place_rows(documents: DataFrame, slots: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """``documents`` with shard and vslot. No shuffle: the map has n_slots rows, so it is broadcast. All
    copies of a row count as one run here and share a slot. A map of another number of slots is refused."""
    _same_slots(slots, n_slots)
    shard, vslot = (fresh_name(documents, n) for n in ("shard", "vslot"))
    placed = documents.withColumn(vslot, slot_of(n_slots, F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))), F.lit(0)))
    right = slots.select(F.col("vslot").alias(f"{vslot}_key"), F.col("shard").alias(shard))
    return placed.join(F.broadcast(right), placed[vslot] == right[f"{vslot}_key"]).select(*documents.columns, shard, vslot)


def shard(documents: DataFrame, shards: int = SHARDS, n_slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """A row per document with its shard and its place there, ``slot``, gapless from 0.

    The map is kept in ``folder`` (by default a new one in the shared folder): its newest version, or one
    that deals slots in turn, is edited for the bytes there are now, stored as the next version, and read
    back from there. Places are counted inside the virtual slots, never over a whole shard: a shard's slots
    follow each other and the map has where each begins. A stored map of another number of slots is refused.
    """
    spark = documents.sparkSession
    cut = durable(runs(documents, n_slots))
    if folder is None:
        folder = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
        save_map(dealt_map(spark, shards, n_slots), folder)
    _same_slots(load_map(spark, folder), n_slots)
    save_map(rebalance(load_map(spark, folder), slot_totals(cut), shards), folder)
    slots = load_map(spark, folder)
    before = F.sum("rows").over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "run").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(slots), "vslot")
    place = F.explode(F.sequence(F.col("first_slot") + F.col("before"), F.col("first_slot") + F.col("before") + F.col("rows") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", place.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
