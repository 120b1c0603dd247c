"""SimHash near-dedup by a generalised pigeonhole.

The 64 bits are grouped into parts, bits that go together into one part. If two fingerprints differ
in at most r bits and the parts' thresholds t_i add up to r - parts + 1, then in some part they differ
in at most t_i bits; a threshold of -1 leaves a part out. A dynamic programme picks the number of
parts and the thresholds for which the estimated number of candidates and probes is least; the
estimate comes from counts over all distinct fingerprints. Probes land in buckets, pairs inside a
bucket are verified, and of each bucket only a spanning forest is passed on, never its pairs.
Buckets too large for that are dealt out again by the bits that their key doesn't fix.

Defined cases: a null, empty or blank text has the fingerprint zero, linked like any other; rows that
repeat are in one component; a null id takes part but names a component only if all ids in it are
null (then component_id is null); an empty table gives an empty result; other columns pass through
``keep_one`` and are ignored by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import bodies, connected_components, durable, fresh_name, wide_hash

RADIUS, SHINGLE, SEED = 3, 3, 42
BUCKET = 20_000  #: fingerprints in a bucket beyond which it is dealt out again
_TABLE = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits: each set if it is set in over half of the hashes of the word shingles."""
    words = (text or b"").translate(_TABLE).split(b" ")
    if b"" in words:
        words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    k = min(shingle, len(words))
    stops = (ends[k - 1 :] - 1).tolist()
    starts = [0, *ends[: len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    n, ones = len(stops), np.zeros(64, dtype=np.int64)
    for a in range(0, n, 1 << 15):
        part = np.array([digest(line[i:j], SEED) for i, j in zip(starts[a : a + (1 << 15)], stops[a : a + (1 << 15)])], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for _, texts in bodies(batch.column("text")) for t in texts]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], [*keep, "fp"])


def fingerprints(documents: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, fp) of every document, and ``more`` columns; fp is the fingerprint as a signed long."""
    light = documents.select("doc_id", "text", *(c.alias(n) for n, c in more.items()))
    schema = T.StructType([light.schema[0], *light.schema[2:], T.StructField("fp", T.LongType())])
    return light.mapInArrow(_prints, schema)


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Over all rows of (fp): their number, and how often bits i and j are both set (64 x 64)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += bits.T @ bits
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(4096), -1]), pa.array([*total.ravel().astype(np.int64).tolist(), n])], ["at", "n"])

    rows = distinct.select("fp").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # 4,097 at most
    found = {r["at"]: r.n for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(4096)], dtype=np.float64).reshape(64, 64)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of near equal size: each group takes the bit most correlated with it."""
    if not n:
        return [list(range(64 * p // parts, 64 * (p + 1) // parts)) for p in range(parts)]
    mean = both.diagonal() / n
    cov = both / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(cov.diagonal(), 1e-9, None))
    corr = np.abs(cov / np.outer(spread, spread))
    left, out = set(range(64)), []
    for p in range(parts):
        want = 64 * (p + 1) // parts - 64 * p // parts
        group = [min(left, key=lambda b: (abs(mean[b] - 0.5), b))]
        left.remove(group[0])
        while len(group) < want:
            b = max(left, key=lambda b: (round(float(corr[b, group].sum()), 9), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def spread_of(n: int, both: np.ndarray, bits: list[int]) -> float:
    """Chance that two fingerprints agree in ``bits``, from the bits' shares and their correlation.

    For each bit in turn, the agreement is conditioned on the earlier bit that it goes with most."""
    mean = both.diagonal() / max(n, 1)
    chance = 1.0
    for k, b in enumerate(bits):
        alone = mean[b] ** 2 + (1 - mean[b]) ** 2
        best = alone
        for a in bits[:k]:
            p11 = both[a, b] / max(n, 1)
            cells = np.array([p11, mean[a] - p11, mean[b] - p11, 1 - mean[a] - mean[b] + p11])
            best = max(best, float((cells**2).sum() / max(mean[a] ** 2 + (1 - mean[a]) ** 2, 1e-9)))
        chance *= min(1.0, best)
    return chance


def plan(n: int, both: np.ndarray, radius: int = RADIUS, widest: int = 8, probe_cost: float = 50.0) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the parts that are probed, for the least estimated cost.

    Cost of a part with threshold t: n probes for each of the values within t bits, and the pairs
    expected to meet there. For each number of parts the thresholds come from a dynamic programme over the
    budget radius - parts + 1, thresholds being -1 (left out) to radius."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, widest + 1):
        groups = grouped_bits(n, both, parts)
        chances = [spread_of(n, both, g) for g in groups]

        def cost(i: int, t: int) -> float:
            if t < 0:
                return 0.0
            near = sum(comb(len(groups[i]), d) for d in range(t + 1))
            return probe_cost * n * near + n * n * min(1.0, chances[i] * near)

        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i in range(parts):
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (c, ts) in table.items():
                for t in range(-1, radius + 1):
                    new = (c + cost(i, t), [*ts, t])
                    if spent + t not in after or new < after[spent + t]:
                        after[spent + t] = new
            table = after
        total, ts = table[radius - parts + 1]
        if best is None or total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, ts) if t >= 0])
    return best[1]


def _packed(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each number, moved together."""
    out = np.zeros(len(x), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _probes(parts: list[tuple[list[int], int]], radius: int):
    """(path, value, extra, fp) for each value within a part's threshold of a fingerprint's."""
    masks = []
    for bits, t in parts:
        near = [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(bits)), d)]
        masks.append(np.array(near, dtype=np.uint64))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for p, (bits, _) in enumerate(parts):
                value = _packed(x, bits)
                for m in masks[p]:
                    key = (value ^ m).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, dtype=np.int64)), pa.array(key), pa.array(np.zeros(len(x), dtype=np.int64)), pa.array(x.view(np.int64))], ["path", "value", "extra", "fp"])

    return probed


def _near_forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect exactly what pairs within ``radius`` connect: (member, least of its tree)."""
    x = np.unique(members)
    root = np.arange(len(x))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    most, a, step = max(1, 2_000_000 // max(1, len(x))), 0, 1
    while a < len(x):  # few rows at first: where most are near each other, they join all the rest
        near = np.bitwise_count(x[a : a + step, None] ^ x[None, a:]) <= radius
        i, j = np.nonzero(near)
        i, j = i + a, j + a
        keep = (j > i) & (root[i] != root[j])
        for u, v in zip(i[keep].tolist(), j[keep].tolist()):
            u, v = top(u), top(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        while (root[root] != root).any():
            root = root[root]
        a, step = a + step, min(most, 2 * step)
    signed = x.view(np.int64)
    return [(int(signed[i]), int(signed[top(i)])) for i in range(len(x)) if top(i) != i]


def _forests(radius: int):
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lists.offsets.to_numpy()
            at = at - at[0]
            size = np.diff(at)
            edges: list[tuple[int, int]] = []
            two = np.flatnonzero(size == 2)  # most buckets
            a, b = flat[at[two]], flat[at[two] + 1]
            near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
            edges += zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist())
            for k in np.flatnonzero(size > 2).tolist():
                edges += _near_forest(flat[at[k] : at[k + 1]], radius)
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return joined


def _deeper(paths: dict[int, tuple[list[int], list[int]]], radius: int):
    """Deals rows out again: once for each of radius + 1 pieces of the bits that their key leaves
    free. A pair within the radius agrees in one of these pieces at least."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, value, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "value", "fp"))
            for p in np.unique(path).tolist():
                here = path == p
                own = x[here].astype(np.int64).view(np.uint64)
                fixed, free = paths[p]
                for q in range(radius + 1):
                    extra = _packed(own, [*fixed, *free[q :: radius + 1]]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p * (radius + 1) + q, dtype=np.int64)), pa.array(value[here].astype(np.int64)), pa.array(extra), pa.array(own.view(np.int64))], ["path", "value", "extra", "fp"])

    return dealt


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): forests of the fingerprints of (fp) that are within ``radius`` bits, bucket by bucket."""
    n, both = bit_counts(distinct)
    parts = plan(n, both, radius)
    key, columns = ["path", "value", "extra"], "path long, value long, extra long, fp long"
    probes = distinct.select("fp").mapInArrow(_probes(parts, radius), columns)
    paths: dict[int, tuple[list[int], list[int]]] = {p: ([], [b for b in range(64) if b not in bits]) for p, (bits, _) in enumerate(parts)}
    out = None
    while True:
        small, again = probes, None
        if max(len(free) for _, free in paths.values()) > radius:  # else members differ in the key alone
            large = durable(probes.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > bucket).select(*key))
            if not large.isEmpty():
                small, again = probes.join(large, key, "left_anti"), probes.join(large, key, "left_semi")
        lists = small.groupBy(*key).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        edges = lists.mapInArrow(_forests(radius), "a long, b long")
        out = edges if out is None else out.union(edges)
        if again is None:
            return out
        probes = durable(again.select("path", "value", "fp").mapInArrow(_deeper(paths, radius), columns))
        paths = {p * (radius + 1) + q: ([*fixed, *free[q :: radius + 1]], [b for b in free if b not in free[q :: radius + 1]]) for p, (fixed, free) in paths.items() for q in range(radius + 1)}


def components(documents: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least doc_id reachable."""
    prints = durable(fingerprints(documents))
    return prints.join(component_ids(prints, radius, bucket), "fp", "left").select("doc_id", "fp", "component_id")


def component_ids(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, name: str | Column = "doc_id") -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of (doc_id, fp); the least ``name`` is the id."""
    distinct = durable(prints.groupBy("fp").agg(F.min(name).alias("least")))
    roots = connected_components(links(distinct, radius, bucket))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return durable(named.select("fp", "root").join(least, "root").select("fp", "component_id"))


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    return components(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with its columns: that of the least id (null ids last), and among rows
    of that id the one whose text hashes lowest. Components that share an id, or have null ids only,
    keep a row each."""
    prints = durable(fingerprints(documents, own=wide_hash(F.col("text"))))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "own")
    found = prints.join(component_ids(prints, radius, name=rank), "fp", "left")
    gone = durable(found.where(~rank.eqNullSafe(F.col("component_id"))).select("doc_id", "own").distinct())
    own, gone_id, gone_own = (fresh_name(documents, n) for n in ("own", "gone_id", "gone_own"))
    left = documents.withColumn(own, wide_hash(F.col("text")))
    right = gone.select(F.col("doc_id").alias(gone_id), F.col("own").alias(gone_own))
    kept = left.join(right, left["doc_id"].eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_own)), "left_anti")
    repeats = prints.groupBy("doc_id", "own").agg(F.count("*").alias("n")).where("n > 1")
    return (kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", own])).drop(own)
