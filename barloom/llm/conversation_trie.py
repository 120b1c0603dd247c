"""The prefix trie of conversations, rolled up by depth bands.

Each distinct sequence of first turns is a node. A node's key is the exclusive or of hashes of its turns,
each hashed with its place, so keys of all prefixes are running totals and no text is moved. Totals of
subtrees come band by band: inside a band of ``height`` depths a node's own values are added to its
ancestors in that band, of which there are ``height`` at most. The first nodes of the bands form a trie of
their own, ``height`` times less deep, which is rolled up in the same way; what it finds for a band's
first node is complete, and goes to that node's ancestors in the band before. So a trie of depth d takes
log(d) / log(height) rounds, and a node is exploded to ``2 * height`` rows at most, however deep it is.

A conversation of more than ``span`` turns is numbered and hashed in pieces, whose totals are carried
over, so that no task has to take all of it; rows of one turn number stay together.

Defined cases: a null role or text is empty; a null turn comes first, and turns of one number follow each
other by the hash of role and text; repeated rows are turns each; rows without conv_id belong to no
conversation; conversations without turns are members of the root; an empty table has no nodes; columns
beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import durable

HEIGHT = 16  #: depths in a band
SPAN = 4096  #: turns of a conversation that are numbered in one piece
ENDS = 1024  #: consecutive ids that are gathered into one piece of a digest
FAMILY, HEADS = 5, 9  #: the rebuilding of the registered query: c - c % 5, and crc32 % 9


def _carried(pieces: DataFrame, key: str, piece: str, total: Column, names: list[str]) -> DataFrame:
    """(key, piece, names) of what all earlier pieces of a key add up to, for pieces that have some."""
    before = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(key, piece, *[total(n).over(before).alias(n) for n in names]).where(F.col(names[0]).isNotNull())


def turns(conversations: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """((conv_id, at, a, b, bytes) of every turn, and (conv_id, n) of every conversation); ``at`` counts from 1, (a, b) is
    the hash of role and text."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    piece = F.coalesce(F.floor(F.col("turn").cast("decimal(20,0)") / span).cast("long"), F.lit(-(2**62))).alias("piece")
    sizes = durable(rows.groupBy("conv_id", piece).agg(F.count("*").alias("n")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = rows.select("conv_id", piece, "turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id", "piece").orderBy(F.asc_nulls_first("turn"), "a", "b")
    placed = hashed.withColumn("at", F.row_number().over(order).cast("long"))
    earlier = _carried(sizes.withColumnRenamed("n", "before"), "conv_id", "piece", F.sum, ["before"])
    if not earlier.isEmpty():
        placed = placed.join(earlier, ["conv_id", "piece"], "left").withColumn("at", F.col("at") + F.coalesce("before", F.lit(0)))
    return placed.select("conv_id", "at", "a", "b", "bytes"), sizes.groupBy("conv_id").agg(F.sum("n").alias("n"))


def _heads(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(conversations: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The same two tables after every conversation c has begun with the first turns of conversation c - c % 5.

    Of an original turn at most five copies are made, and only of the first eight."""
    every, sizes = turns(conversations, span)
    sizes = durable(sizes)
    base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    head = F.least(_heads(F.col("conv_id")), F.coalesce("base_n", F.lit(0)))
    plan = plan.select("conv_id", "n", head.alias("head"), (head + F.greatest(F.col("n") - _heads(F.col("conv_id")), F.lit(0))).alias("length"))
    near = F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda k: F.col("conv_id") + k)
    family = F.filter(near, lambda c: (c - c % FAMILY == F.col("conv_id")) & (F.col("at") <= _heads(c)))
    as_head = F.when((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS), F.transform(family, lambda c: F.struct(c.alias("conv_id"), F.lit(True).alias("lent"))))
    as_own = F.when(F.col("at") > _heads(F.col("conv_id")), F.array(F.struct("conv_id", F.lit(False).alias("lent"))))
    none = F.array().cast("array<struct<conv_id:bigint,lent:boolean>>")
    used = every.select(F.explode(F.concat(F.coalesce(as_head, none), F.coalesce(as_own, none))).alias("to"), "at", "a", "b", "bytes").select("to.*", "at", "a", "b", "bytes")
    at = F.when(F.col("lent"), F.col("at")).otherwise(F.col("at") - _heads(F.col("conv_id")) + F.col("head"))
    placed = used.join(plan, "conv_id").select("conv_id", at.alias("at"), "a", "b", "bytes", "length")
    return placed, plan.select("conv_id", F.col("length").alias("n"))


def paths(every: DataFrame, sizes: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, bytes, ends) for the root and every turn: the keys of the prefix that ends there and
    of the prefix before; ``ends`` is 1 at a conversation's last turn."""
    lanes = every.select("conv_id", "at", "bytes", F.shiftright(F.col("at") - 1, span.bit_length() - 1).alias("piece"), F.xxhash64("at", "a", "b").alias("xa"), F.xxhash64(F.lit("second"), "at", "a", "b").alias("xb"))
    so_far = Window.partitionBy("conv_id", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    longest = sizes.agg(F.max("n")).first()[0] or 0
    if longest > span:
        lanes = durable(lanes)
        carried = _carried(lanes.groupBy("conv_id", "piece").agg(F.bit_xor("xa").alias("ca"), F.bit_xor("xb").alias("cb")), "conv_id", "piece", F.bit_xor, ["ca", "cb"])
        lanes = lanes.join(carried, ["conv_id", "piece"], "left")
    else:
        lanes = lanes.withColumns({"ca": F.lit(0).cast("long"), "cb": F.lit(0).cast("long")})
    none = F.lit(0).cast("long")
    key = {f"k{x}": F.bit_xor(f"x{x}").over(so_far).bitwiseXOR(F.coalesce(f"c{x}", none)) for x in "ab"}
    keyed = lanes.withColumns(key).join(sizes, "conv_id")
    below = keyed.select("conv_id", F.col("at").alias("depth"), "ka", "kb", F.col("ka").bitwiseXOR(F.col("xa")).alias("pa"), F.col("kb").bitwiseXOR(F.col("xb")).alias("pb"), "bytes", (F.col("at") == F.col("n")).cast("long").alias("ends"))
    root = sizes.select("conv_id", none.alias("depth"), none.alias("ka"), none.alias("kb"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), none.alias("bytes"), (F.col("n") == 0).cast("long").alias("ends"))
    return root.unionByName(below)


def _steps(path: DataFrame, height: int) -> DataFrame:
    """``path`` (conv_id, depth, ka, kb, pa, pb) with ``up``: the keys above, from the first depth of the band in which
    the parent lies down to the parent."""
    band = Window.partitionBy("conv_id", F.floor((F.col("depth") - 1) / height)).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return path.where("depth > 0").withColumn("up", F.collect_list(F.struct(F.col("pa").alias("ka"), F.col("pb").alias("kb"))).over(band))


def subtree_sums(nodes: DataFrame, path: DataFrame, names: list[str], deepest: int, height: int = HEIGHT) -> DataFrame:
    """(ka, kb, names): the sums of ``names`` over each node's subtree, itself included.

    ``nodes`` (ka, kb, conv_id, depth, names) has every node once, with any conversation through it; ``path``
    has the steps (conv_id, depth, ka, kb, pa, pb) of these conversations.
    """
    steps = _steps(path, height)
    own = durable(nodes.select("ka", "kb", "conv_id", "depth", *names).join(steps.select("conv_id", "depth", "up"), ["conv_id", "depth"], "left"))
    itself = F.array(F.struct("ka", "kb"))
    inside = F.when(F.col("depth") % height == 0, itself).otherwise(F.concat(F.col("up"), itself))
    banded = own.select(F.explode(inside).alias("k"), *names).groupBy("k.ka", "k.kb").agg(*[F.sum(n).alias(n) for n in names])
    if deepest < height:
        return banded
    banded = durable(banded)
    firsts = own.where(F.col("depth") % height == 0).drop(*names).join(banded, ["ka", "kb"])
    higher = steps.where(F.col("depth") % height == 0).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "ka", "kb", F.col("up")[0]["ka"].alias("pa"), F.col("up")[0]["kb"].alias("pb"))
    whole = durable(subtree_sums(firsts.withColumn("depth", (F.col("depth") / height).cast("long")), higher, names, deepest // height, height))
    # what a band's first node has in all goes to its ancestors in the band before
    sent = whole.join(own.where(F.col("depth") % height == 0).select("ka", "kb", "up"), ["ka", "kb"]).select(F.explode("up").alias("k"), *names)
    passed = sent.groupBy("k.ka", "k.kb").agg(*[F.sum(n).alias(f"{n}_below") for n in names])
    return banded.join(passed, ["ka", "kb"], "left").select("ka", "kb", *[(F.col(n) + F.coalesce(f"{n}_below", F.lit(0))).alias(n) for n in names])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ka, kb, ids) in order: SHA-256 of each key's ids, joined by commas, one piece in memory at a time."""
    key, state = None, None

    def row(k, s) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((k[0], pa.int64()), (k[1], pa.int64()), (s.hexdigest(), pa.string()))], ["ka", "kb", "ends_sha256"])

    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids"))):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))], ["ka", "kb", "ends_sha256"])
    if key is not None:
        yield row(key, state)


def end_digests(ends: DataFrame, block: int = ENDS) -> DataFrame:
    """(ka, kb, ends_sha256) of the conversations (conv_id, ka, kb) that end at each node, ids ascending.

    Ids are put together in blocks first, so a node where many end takes a row for each block."""
    pieces = ends.groupBy("ka", "kb", F.shiftright("conv_id", block.bit_length() - 1).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    texts = pieces.select("ka", "kb", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return texts.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "block").drop("block").mapInArrow(_digested, "ka long, kb long, ends_sha256 string")


def trie(every: DataFrame, sizes: DataFrame, height: int = HEIGHT, span: int = SPAN) -> DataFrame:
    """One row per node of the conversations (conv_id, at, a, b, bytes), of lengths (conv_id, n)."""
    path = durable(paths(every, sizes, span))
    nodes = path.groupBy("ka", "kb").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("ends").alias("ends"))
    # a node is a leaf if all that pass it end there
    nodes = durable(nodes.withColumns({"n_leaves": (F.col("ends") == F.col("n_convs")).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(nodes, path.drop("bytes", "ends"), ["n_leaves", "saved_tokens"], deepest, height)
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    # the least member of a node is that of all nodes below it on its path: only the first such node has another parent
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    under = nodes.join(tops, "conv_id")
    other = under.where("depth = top and depth > 0").select("conv_id", "depth", "pa", "pb")
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent"))
    named = under.join(other.join(parents, ["pa", "pb"]).select("conv_id", "depth", "parent"), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    out = named.select("ka", "kb", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs").join(sums, ["ka", "kb"]).join(children, ["ka", "kb"], "left")
    out = out.join(end_digests(path.where("ends = 1").select("conv_id", "ka", "kb")), ["ka", "kb"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def report(conversations: DataFrame, height: int = HEIGHT, span: int = SPAN) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt(conversations, span), height, span)
