"""Repair of the structure of conversations, by a suffix-shared automaton.

Each row of a conversation is one symbol: the first letter of its role and its fault. Two conversations
need the same edits from a row on if the same symbols follow, whatever their texts, so the suffixes of all
conversations' signatures are the nodes of one automaton, built from the end. For each node and each state
of the grammar of roles it holds the cost to go and the cheapest edits from there on, linked to those of the
node behind. Distinct signatures are sorted by their reversed text: suffixes that conversations share then
follow each other, so one pass that keeps the nodes of the current signature works each node out once (and
once more where a range of signatures begins).

A signature is a character per row and an audit a character per edit; texts are read in order, one after the
other, to be hashed, so of a conversation only these two short strings are ever held whole. All the same a
conversation is put in order by one task, as its row in the result is one.

Defined cases: null roles and texts are one space (and a null turn in the key that decides on damage); a
null turn comes first; turns of one number follow each other by the hash of role and text; repeated rows
are rows each, and duplicates; rows without conv_id are one conversation with a null id; a conversation of
which no row is left has zeros and empty strings; an empty table gives an empty result; columns beyond
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import bodies, durable, let, wide_hash

BLANK = " \t\n\x0b\x0c\r"  #: what doesn't count as text
ENDINGS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  #: costs; keeping a row costs nothing
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  #: (s?(ua)+)? as steps from the states begin, after s, u and a
NAMES = {"u": "user", "a": "assistant"}


def _only(state: int) -> str:
    """The role, of user and assistant, that may come next."""
    return "u" if "u" in GRAMMAR[state] else "a"


#: to the end of a conversation: the relative cost and the edits of each state
_END = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""))


@lru_cache(maxsize=None)
def _step(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """For each state before a row: (cost, edits up to and with the row, state behind it), the cheapest and of
    these the least in letters, given the costs from the states behind it on.

    ``symbol`` is x for a row that has to go, else a role's first letter or o, in upper case if truncated. Costs
    of states differ by a few units only, so there are few different calls."""
    role, more = symbol.lower(), TRUNCATED * symbol.isupper()
    row: list[list[tuple[int, str, int]]] = []
    for state in range(4):
        ways = [(DELETE + after[state], "D", state)]
        if symbol != "x":
            if role in GRAMMAR[state]:
                ways.append((more + after[GRAMMAR[state][role]], "K", GRAMMAR[state][role]))
            behind = GRAMMAR[state][_only(state)]
            ways.append((REROLE + more + after[behind], "R", behind))
        row.append(ways)
    out = []
    for state in range(4):
        ways, now = [], state
        for inserted in range(3):  # a third insertion leads to where one leads
            ways += [(INSERT * inserted + cost, "I" * inserted + edit, behind) for cost, edit, behind in row[now]]
            now = GRAMMAR[now][_only(now)]
        out.append(min(ways))
    return tuple(out)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tail, cost, audit) of sorted reversed signatures. A node is (least cost, costs above it, edits by state); edits
    are (text, edits behind) so that nodes share them."""
    last, nodes = "", [(0, _END[0], tuple((e, None) for e in _END[1]))]
    for batch in batches:
        tails = batch.column(0).to_pylist()
        costs, audits = [], []
        for tail in tails:
            shared = len(commonprefix((last, tail)))
            del nodes[shared + 1 :]
            for symbol in tail[shared:]:
                least, costs_behind, edits = nodes[-1]
                steps = _step(symbol, costs_behind)
                low = min(cost for cost, _, _ in steps)
                nodes.append((least + low, tuple(cost - low for cost, _, _ in steps), tuple((edit, edits[behind]) for _, edit, behind in steps)))
            last = tail
            least, above, edits = nodes[-1]
            parts, cell = [], edits[0]
            while cell is not None:
                parts.append(cell[0])
                cell = cell[1]
            costs.append(least + above[0])
            audits.append("".join(parts))
        yield pa.RecordBatch.from_arrays([pa.array(tails, pa.string()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["tail", "cost", "audit"])


def audits(tails: DataFrame) -> DataFrame:
    """(tail, cost, audit) of every distinct reversed signature (tail)."""
    return tails.distinct().repartitionByRange("tail").sortWithinPartitions("tail").mapInArrow(_solved, "tail string, cost long, audit string")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text): rows with the faults that their id and turn call for."""
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDINGS, "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.where(kind != 0)
    return rows.select("conv_id", "turn", F.explode(copies).alias("copy"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"))


def _order(*before: str) -> list[Column]:
    return [*map(F.col, before), F.asc_nulls_first("turn"), F.col("own.a"), F.col("own.b"), F.col("copy")]


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, tail) of conversations; tail is the signature, last row first."""
    bare = F.rtrim("text", F.lit(BLANK))
    shape = let(bare, lambda t: F.when(t == "", "x").when(F.substring(t, -1, 1).isin(*ENDINGS), "n").otherwise("t"))
    light = rows.select("conv_id", "turn", "copy", F.substring("role", 1, 1).alias("initial"), shape.alias("shape"), wide_hash(F.struct("role", "text")).alias("own"))
    order = Window.partitionBy("conv_id").orderBy(*_order())
    seen = F.row_number().over(Window.partitionBy("conv_id", "own").orderBy(F.asc_nulls_first("turn"), "copy")) > 1
    before, earlier = F.lag("initial").over(order), F.lag("turn").over(order)
    fault = F.when(F.col("shape") == "x", "blank").when(F.col("seen"), "duplicate").when(F.col("shape") == "t", "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    told = light.withColumn("seen", seen).withColumn("fault", fault).select(
        "conv_id", "turn", "fault", F.row_number().over(order).alias("at"), symbol.alias("symbol"),
        (before.isNotNull() & ~F.concat(before, F.col("initial")).isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(earlier)).alias("new_turn"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    tail = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "symbol")), asc=False), lambda r: r["symbol"]), "")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    return told.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *counts, F.count_if("illegal").alias("illegal"), tail.alias("tail"))


class _Repaired:
    """The digest of one conversation's repaired rows, taken one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, 0, hashlib.sha256(), False

    def put(self, role: bytes, text: bytes) -> None:
        self.digest.update(b"\n" * self.begun + role + b":")
        self.digest.update(text)
        self.begun = True
        self.state = GRAMMAR[self.state][role[:1].decode()]

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(NAMES[_only(self.state)].encode(), b"")
            self.at += 1

    def row(self, role: bytes, text: bytes) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else NAMES[_only(self.state)].encode(), text)

    def end(self) -> str:
        self.insert()
        return self.digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order, each conversation's after its audit (a null role): (conv_id, repaired_sha256)."""
    now, done, kind = None, [], None

    def out() -> pa.RecordBatch:
        ids, digests = zip(*done) if done else ((), ())
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        ids, roles, kind = batch.column("conv_id"), batch.column("role").cast(pa.binary()), batch.column("conv_id").type
        for start, texts in bodies(batch.column("text")):
            for k, text in enumerate(texts, start):
                role = roles[k].as_py()
                if role is None:
                    if now is not None:
                        done.append((now[0], now[1].end()))
                    now = (ids[k].as_py(), _Repaired(text.decode()))
                else:
                    now[1].row(role, text)
        yield out()
    if now is not None:
        done.append((now[0], now[1].end()))
        yield out()


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of damaged ``rows`` and the audits (conv_id, audit) of their conversations. Texts are
    moved once, and none is held but those that are being hashed."""
    own = wide_hash(F.struct("role", "text"))
    first = found.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = first.withColumn("part", F.lit(0)).unionByName(rows.withColumn("part", F.lit(1))).withColumn("own", own)
    schema = T.StructType([rows.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    return both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "part")).select("conv_id", "role", "text").mapInArrow(_hashed, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    rows = damaged(conversations)
    told = durable(signatures(rows))
    found = durable(told.join(audits(told.select("tail")), "tail").drop("tail"))
    digested = digests(rows, found)
    out = conversations.select("conv_id").distinct()
    for more in (found, digested):
        right = more.withColumnRenamed("conv_id", "same_id")
        out = out.join(right, F.col("conv_id").eqNullSafe(F.col("same_id")), "left").drop("same_id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
