"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is cut into windows of ten words. Each window is a set of shingles ordered by
rarity in the documents; as a window has to be contained whole, its necessary prefix is its rarest
shingle alone. Documents that are shorter than the shortest window can't contain one and are passed
over; the others are probed for that shingle, the window's place is fixed by the shingle's offset and
has to lie within the document, and what is left is compared word by word.

The benchmark is read in blocks of bounded size, one in the driver at a time, and each is broadcast and
let go again. A benchmark of one block is looked for in the pass that gives the result, without a
shuffle. With more blocks, each pass stores only what it hit, and the hits meet their documents by one
join; so neither the driver nor a worker ever holds two blocks.

Defined cases: a null or wordless text has no words and no hits; items without words are no windows;
an item with a null id marks words but isn't counted; items that repeat count once per id; an item of
any length is cut into pieces that share its windows; rows that repeat have the same hits; an empty
benchmark hits nothing; other columns pass through ``annotate`` and are ignored by ``report``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import bodies, durable, fresh_name, wide_hash

WINDOW, SHINGLE = 10, 3
BLOCK_WORDS = 500_000  #: words of benchmark items in a block: bounds what the driver builds and broadcasts
_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"


def words(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII, after lower-casing A-Z."""
    return (text or b"").translate(_TABLE).split()


class Block:
    """The windows of some items, indexed by shingle; ``counts`` fixes the order of rarity."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        self.shingle = shingle
        split = [(i, words(t)) for i, t in items]
        self.ids = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, ws in split:
            coded = [self.ids[w] for w in ws]
            for a in range(max(1, len(coded) - window + 1) if coded else 0):
                owners.setdefault(tuple(coded[a : a + window]), set()).add(item)
        self.windows = sorted(owners)
        self.owners = [owners[w] for w in self.windows]
        self.base = len(self.ids) + 1
        if self.base**shingle >= 2**63:
            raise ValueError("block_words has to be smaller for shingles of so many words")
        self.widths = sorted({min(shingle, len(w)) for w in self.windows})
        self.codes = {k: np.unique(np.concatenate([self.coded(np.array(w), k) for w in self.windows if min(shingle, len(w)) == k])) for k in self.widths}

    def coded(self, ids: np.ndarray, k: int) -> np.ndarray:
        """One number per shingle of k words, -1 where a word isn't the benchmark's."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        code, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(k):
            part = ids[j : j + n]
            code = code * self.base + part
            known &= part >= 0
        return np.where(known, code, -1)

    def numbered(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all ``texts`` as numbers, -1 if unknown and after each text, and where each text starts."""
        get = self.ids.get
        out, starts = [], [0]
        for t in texts:
            out.extend([get(w, -1) for w in words(t)])
            out.append(-1)
            starts.append(len(out))
        return np.array(out, dtype=np.int64), np.array(starts, dtype=np.int64)

    def seen(self, texts: list[bytes | None]) -> dict[int, np.ndarray]:
        """How often each shingle of the block occurs in ``texts``."""
        ids, _ = self.numbered(texts)
        out = {}
        for k in self.widths:
            code = self.coded(ids, k)
            code = code[code >= 0]
            at = np.minimum(np.searchsorted(self.codes[k], code), len(self.codes[k]) - 1)
            out[k] = np.bincount(at[self.codes[k][at] == code], minlength=len(self.codes[k]))
        return out

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Picks every window's rarest shingle, its prefix."""
        self.prefix = {}
        for k in self.widths:
            by_code: list[tuple[int, int, int]] = []
            for n, w in enumerate(self.windows):
                if min(self.shingle, len(w)) == k:
                    at = np.searchsorted(self.codes[k], self.coded(np.array(w), k))
                    offset = int(np.lexsort((at, counts[k][at]))[0])
                    by_code.append((int(at[offset]), n, offset))
            by_code.sort()
            rare, number, offset = (np.array(x, dtype=np.int64) for x in zip(*by_code))
            self.prefix[k] = (self.codes[k][np.unique(rare)], np.searchsorted(rare, np.unique(rare)), np.bincount(np.searchsorted(np.unique(rare), rare)), number, offset)
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.padded = np.array([[*w, *[-2] * (max(map(len, self.windows)) - len(w))] for w in self.windows], dtype=np.int64)

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, the merged spans of words hit, and the items found."""
        ids, starts = self.numbered(texts)
        lengths = np.diff(starts) - 1
        shortest = self.lengths.min() if len(self.windows) else 0
        begins, wins = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for k in self.widths:
            rare, first, many, number, offset = self.prefix[k]
            code = self.coded(ids, k)
            at = np.flatnonzero(code >= 0)
            slot = np.minimum(np.searchsorted(rare, code[at]), len(rare) - 1)
            hit = rare[slot] == code[at]
            at, slot = at[hit], slot[hit]
            own = np.searchsorted(starts, at, side="right") - 1
            long = lengths[own] >= shortest  # the bound on lengths
            at, slot, own = at[long], slot[long], own[long]
            step = max(1, 4_000_000 // max(1, int(many.max())))
            for a in range(0, len(at), step):  # bounds the candidates in memory at once
                p, s, d = at[a : a + step], slot[a : a + step], own[a : a + step]
                n = many[s]
                pick = np.repeat(first[s] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                begin, win = np.repeat(p, n) - offset[pick], number[pick]
                doc = np.repeat(d, n)
                ok = (begin >= starts[doc]) & (begin + self.lengths[win] <= starts[doc] + lengths[doc])  # the bound on positions
                begin, win = begin[ok], win[ok]
                for j in range(self.padded.shape[1]):  # verification; most fail at once
                    want = self.padded[win, j]
                    same = (want == -2) | (ids[np.minimum(begin + j, len(ids) - 1)] == want)
                    begin, win = begin[same], win[same]
                begins.append(begin)
                wins.append(win)
        begin, win = np.concatenate(begins), np.concatenate(wins)
        doc = np.searchsorted(starts, begin, side="right") - 1
        order = np.lexsort((begin, doc))
        out = [(int(b - a - 1), [], set()) for a, b in zip(starts, starts[1:])]
        for d, b, w in zip(doc[order].tolist(), begin[order].tolist(), win[order].tolist()):
            _, spans, items = out[d]
            a, z = b - int(starts[d]), b - int(starts[d]) + int(self.lengths[w])
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(z, spans[-1][1]))
            else:
                spans.append((a, z))
            items |= self.owners[w]
        return [(n, spans, sorted(i for i in items if i is not None)) for n, spans, items in out]


def _merged(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted([*one, *other]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's items, streamed to the driver in lists of ``block_words`` words (and less than a
    window more). An item that doesn't fit is cut into pieces that share window - 1 words. Always one list
    at least."""
    kept: list[tuple[str | None, bytes]] = []
    size, first = 0, True
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.encode("text", "utf-8").alias("t")).where("t is not null").toLocalIterator():
        left = words(bytes(r.t))
        at, end = 0, len(left)
        while end and (at == 0 or end - at >= window):
            piece = left[at : at + max(block_words - size, window)]
            kept.append((r.i, b" ".join(piece)))
            size += len(piece)
            if size >= block_words:
                yield kept
                kept, size, first = [], 0, False
            at += max(len(piece) - window + 1, 1)
    if kept or first:
        yield kept


def _rarity(documents: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """Counts of the block's shingles over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, texts in bodies(batch.column(0), 10_000):
                for k, v in shared.value.seen(texts).items():
                    total[k] = total[k] + v if k in total else v
        for k, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.int64)), pa.array(v[at].astype(np.int64))], ["k", "at", "n"])

    sums = documents.select("text").mapInArrow(counted, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(c), dtype=np.int64) for k, c in block.codes.items()}
    for r in sums.toLocalIterator():
        out[r.k][r["at"]] = r.n
    shared.unpersist()
    return out


def annotate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str]:
    """``documents`` with all their columns and one more, and its name: a struct of n_words, the
    spans of hit words (merged, ends exclusive) and the ids of the items found (as sorted strings)."""
    name = fresh_name(documents, "found")
    rest = blocks(benchmark, block_words, window)
    items, more = next(rest), next(rest, None)
    if more is None:
        out = documents.withColumn(name, F.lit(None).cast(_FOUND))
        return out.mapInArrow(_finder(_indexed(documents, Block(items, window, shingle)), out.schema), out.schema), name
    hits = None
    for items in chain((items, more), rest):
        block = _indexed(documents, Block(items, window, shingle))
        light = documents.select("text").withColumn(name, F.lit(None).cast(_FOUND))
        found = light.mapInArrow(_finder(block, light.schema), light.schema).where(F.size(f"{name}.spans") > 0)
        found = durable(found.select(wide_hash(F.col("text")).alias("own"), F.col(f"{name}.spans").alias("spans"), F.col(f"{name}.items").alias("items")).distinct())
        block.unpersist()
        hits = found if hits is None else hits.union(found)
    return _gathered(documents, hits, name), name


def _gathered(documents: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """``documents`` with the hits of all blocks; a text has a row of hits per block at most. Documents meet
    them by the hash of their text, and only texts with hits do, so texts that are hit by few blocks
    are few rows; a hash of a text that a third of all rows have is a skewed key on the documents' side alone."""
    own, key = fresh_name(documents, "own"), fresh_name(documents, "own_key")
    texts = hits.groupBy("own").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = documents.withColumn(own, wide_hash(F.col("text"))).join(texts.select(F.col("own").alias(key), F.struct(F.lit(0).cast("long").alias("n_words"), "spans", "items").alias(name)), F.col(own) == F.col(key), "left")
    out = joined.select(*(documents[c] for c in documents.columns), name)
    names = out.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, texts in bodies(batch.column("text"), 10_000):
                for t, old in zip(texts, batch.column(batch.num_columns - 1).slice(a, len(texts)).to_pylist()):
                    spans = _merged([(s["start"], s["end"]) for s in old["spans"]], []) if old else []
                    rows.append({"n_words": len(words(t)), "spans": [{"start": a, "end": z} for a, z in spans], "items": old["items"] if old else []})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, batch.column(batch.num_columns - 1).type)], names)

    return out.mapInArrow(counted, out.schema)


def _indexed(documents: DataFrame, block: Block) -> Broadcast:
    """The block with its windows' prefixes chosen, on all workers."""
    block.order(_rarity(documents, block) if len(block.windows) else {})
    return documents.sparkSession.sparkContext.broadcast(block)


def _finder(shared: Broadcast, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"n_words": n, "spans": [{"start": a, "end": z} for a, z in spans], "items": items}
                for _, texts in bodies(batch.column("text"), 10_000) for n, spans, items in shared.value.find(texts)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, batch.column(batch.num_columns - 1).type)], schema.names)

    return found


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    light, name = annotate(documents.select("doc_id", "text"), benchmark, window, shingle, block_words)
    hit = F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return light.select(
        "doc_id", F.col(f"{name}.n_words"), hit.alias("n_hit"), F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{name}.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The documents in which no window occurs, with their columns."""
    out, name = annotate(documents, benchmark, **options)
    return out.where(F.size(f"{name}.spans") == 0).select(*(out[c] for c in documents.columns))
