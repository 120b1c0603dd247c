"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a bounded sample; a vector's cell is the
pair of its nearest centroids. For every other centroid the way to its side of the border is known, so for each
half there is a list of centroids by the least distance that a neighbour has to cover to lie there. Both lists
are walked as a multi-sequence, which visits cells by the sum of their squared ways, until no further cell can
hold a neighbour that is needed for the target recall; the bound comes from pairs at the threshold. A target of
1 takes the distance at the threshold itself, and then no pair can be missed. Each vector is stored in its own
cell and looks for later vectors in all that it visits, so a pair is verified once.

In a cell only counts of links and a spanning forest are made, never its pairs. Cells beyond ``block`` vectors
are cut into blocks of both sides, each verified by its own task. Equal vectors are one, with their number.

Defined cases: vectors that are null, empty or zero, or have a null or non-finite component, and those without a
label, link with nothing; vectors of unlike length aren't compared; a vector is a row, so repeated rows link
with each other, whatever their ids; a null vec_id takes part, but names a component only if all its ids are
null; an empty table gives an empty result; columns beyond vec_id, embedding and label are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import connected_components, durable, wide_hash

THRESHOLD = 0.98
RECALL = 0.999  #: share of pairs at the threshold, the hardest, that the visited cells have to hold; 1 misses none
SAMPLE, SAMPLE_NUMBERS = 20_000, 4_000_000  #: most vectors, and most numbers, that codebooks are fitted on
PAIRS = 10_000  #: pairs at the threshold that say how far to go
OCCUPANCY = 64  #: vectors of the largest label that a cell is meant for
MAX_CENTROIDS = 1024
BROADCAST_CELLS = 100_000  #: large cells, of four numbers each, up to which they are sent to all
BLOCK = 1024  #: vectors of a side of a cell that are verified at once


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves (of the first 2 * half numbers), and the squared way up to which cells are visited."""

    books: tuple[np.ndarray, np.ndarray]
    cut: int
    reach: float


def units(vectors: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of unit length in double precision, cut or filled with zeros to ``width`` after they were scaled."""
    rows = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    at = rows.offsets.to_numpy().astype(np.int64)
    flat = rows.values.to_numpy(zero_copy_only=False).astype(np.float64)[at[0] : at[-1]]
    sizes = np.diff(at)
    longest = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), longest))
    out[np.arange(longest) < sizes[:, None]] = flat
    out /= np.abs(out).max(axis=1, initial=np.finfo(float).tiny, keepdims=True)
    out /= np.linalg.norm(out, axis=1, keepdims=True).clip(np.finfo(float).tiny)
    if width is None or width == longest:
        return out
    return out[:, :width] if width < longest else np.pad(out, ((0, 0), (0, width - longest)))


def distinct_vectors(embeddings: DataFrame) -> DataFrame:
    """(label, vec, least, n, rid): every different usable vector of a label, its least id, how many rows have it, and
    a number of its own."""
    rows = usable(embeddings).where("own is not null")
    return durable(rows.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("rid", F.monotonically_increasing_id()))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec, own): own is a hash of the vector, null where it links with nothing."""
    kind = embeddings.schema["embedding"].dataType
    number = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    plain = F.transform(F.col("embedding").cast(f"array<{number}>"), lambda x: (x + F.lit(0.0)).cast(number))  # no negative zero
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return embeddings.select("vec_id", "label", plain.alias("vec")).withColumn("own", F.when(F.col("label").isNotNull() & F.col("vec").isNotNull() & fine, wide_hash(F.col("vec"))))


def fitted_book(half: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of rows by Lloyd's method from rows spread evenly; empty ones go."""
    book = np.unique(half[np.linspace(0, len(half) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        near = squared(half, book).argmin(axis=1)
        n = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, half)
        book = total[n > 0] / n[n > 0, None]
    return np.unique(book, axis=0)


def squared(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((rows**2).sum(axis=1)[:, None] - 2 * rows @ book.T + (book**2).sum(axis=1)).clip(0)


def ways(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The square of the least distance from each row to the side of each centroid; 0 for its nearest.

    What is nearest to c lies beyond the plane halfway between c and the row's nearest centroid."""
    away = squared(rows, book)
    home = away.argmin(axis=1)
    between = np.sqrt(squared(book, book))[home]
    between[np.arange(len(rows)), home] = 1.0
    out = (away - away[np.arange(len(rows)), home][:, None]).clip(0) / (2 * between.clip(1e-12))
    return out**2


def fit(sample: np.ndarray, largest: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 7) -> Index:
    """The index of unit vectors like ``sample``, for labels of ``largest`` vectors at most."""
    cut = (sample.shape[1] + 1) // 2
    k = int(np.clip(round((largest / OCCUPANCY) ** 0.5), 1, min(MAX_CENTROIDS, max(1, len(sample) // 4))))
    books = (fitted_book(sample[:, :cut], k), fitted_book(sample[:, cut:], k))
    whole = 2 - 2 * threshold  # the squared distance of unit vectors at the threshold
    if recall >= 1:
        return Index(books, cut, whole * (1 + 1e-9))
    rng = np.random.default_rng(seed)
    x, other, third = (sample[rng.integers(0, len(sample), PAIRS)] for _ in range(3))
    reach = 0.0
    for aside in (rng.standard_normal(x.shape), other - third):  # any direction, and those in which vectors differ
        aside = aside - (aside * x).sum(axis=1, keepdims=True) * x
        long = np.linalg.norm(aside, axis=1, keepdims=True)
        y = threshold * x + (1 - threshold**2) ** 0.5 * aside / long.clip(1e-12)
        needed = np.zeros(len(x))
        for part, book in ((slice(0, cut), books[0]), (slice(cut, None), books[1])):
            needed += ways(x[:, part], book)[np.arange(len(x)), squared(y[:, part], book).argmin(axis=1)]
        reach = max(reach, float(np.quantile(needed[long[:, 0] > 1e-9], recall))) if (long > 1e-9).any() else reach
    return Index(books, cut, min(whole * (1 + 1e-9), reach))


def traversal(first: np.ndarray, second: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, i, j): for all rows at once the next nearest cell, until a row's next is beyond ``reach``.

    ``first`` and ``second`` hold each row's ways in ascending order. A row's front has one cell for every i that is
    reached: the first j not visited yet."""
    n, k = first.shape
    front = np.full((n, k), np.inf)
    front[:, 0] = first[:, 0] + second[:, 0]
    done = np.zeros((n, k), dtype=np.int64)
    rows = np.arange(n)
    while len(rows):
        i = front[rows].argmin(axis=1)
        near = front[rows, i] <= reach
        rows, i = rows[near], i[near]
        j = done[rows, i]
        yield rows, i, j
        done[rows, i] += 1
        more = j + 1 < second.shape[1]
        front[rows, i] = np.where(more, first[rows, i] + second[rows, np.minimum(j + 1, second.shape[1] - 1)], np.inf)
        opens = (j == 0) & (i + 1 < k)
        front[rows[opens], i[opens] + 1] = first[rows[opens], i[opens] + 1] + second[rows[opens], 0]


def _visits(index: Index, with_vectors: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every cell that a vector visits, its own one first."""

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = index.books
        names = ["label", "rid", "n", "vec"] if with_vectors else ["label"]
        for big in batches:
            at = big.column("vec").offsets
            numbers = max(1, at[-1].as_py() - at[0].as_py())
            step = max(1, min(1024, SAMPLE_NUMBERS * big.num_rows // numbers))  # fewer rows of long vectors
            for start in range(0, big.num_rows, step):
                batch = big.slice(start, step)
                unit = units(batch.column("vec"), index.cut + b.shape[1])
                lists = [ways(unit[:, : index.cut], a), ways(unit[:, index.cut :], b)]
                order = [x.argsort(axis=1, kind="stable") for x in lists]
                first, second = (np.take_along_axis(x, o, axis=1) for x, o in zip(lists, order))
                size = pa.array(np.diff(batch.column("vec").offsets.to_numpy()).astype(np.int32))
                held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for turn, (rows, i, j) in enumerate(traversal(first, second, index.reach)):
                    held.append((rows, order[0][rows, i] * len(b) + order[1][rows, j], np.full(len(rows), turn == 0)))
                    if sum(len(h[0]) for h in held) >= 1 << 14:
                        yield sent(batch, size, names, held)
                if held:
                    yield sent(batch, size, names, held)

    def sent(batch, size, names, held) -> pa.RecordBatch:
        rows, cell, home = (np.concatenate(x) for x in zip(*held))
        held.clear()
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), size.take(at), pa.array(cell.astype(np.int64)), pa.array(home)], [*names, "size", "cell", "home"])

    return visited


def forest(linked: np.ndarray) -> np.ndarray:
    """The least member of each row's component in a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root, len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verified(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        n = table.column("n").to_numpy()
        unit = units(table.column("vec"))
        data = np.flatnonzero(table.column("as_data").to_numpy(zero_copy_only=False))
        asks = np.flatnonzero(table.column("as_query").to_numpy(zero_copy_only=False))
        linked = np.zeros((len(rid), len(rid)), dtype=bool)
        for k in range(0, len(asks), 512):
            q = asks[k : k + 512]
            linked[np.ix_(q, data)] = (unit[q] @ unit[data].T >= threshold) & (rid[q][:, None] < rid[data])
        links = linked @ n + linked.T @ n
        found = np.flatnonzero(links)
        near = linked[np.ix_(found, found)]
        order = np.argsort(rid[found])  # so that the least place is the least number
        near = near[np.ix_(order, order)]
        members = rid[found][order]
        return pa.table({"rid": members, "links": links[found][order].astype(np.int64), "other": members[forest(near | near.T)]})

    return verify


def linked(distinct: DataFrame, index: Index, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(rid, links, other): rows that have links in a block of a cell, how many, and another row of their component."""
    label = distinct.schema["label"]
    key = ["label", "size", "cell"]
    cells = [T.StructField("size", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("home", T.BooleanType())]
    rows = distinct.select("label", "rid", "n", "vec")
    places = rows.mapInArrow(_visits(index, False), T.StructType([label, *cells]))
    large = places.groupBy(*key).agg(F.count_if("home").alias("stored"), F.count("*").alias("asking")).where(F.greatest("stored", "asking") > block)
    cuts = durable(large.select(*key, *[F.ceil(F.col(c) / block).cast("int").alias(f"{c}_blocks") for c in ("stored", "asking")]))
    if cuts.count() <= BROADCAST_CELLS:
        cuts = F.broadcast(cuts)
    visits = rows.mapInArrow(_visits(index, True), T.StructType([label, distinct.schema["rid"], distinct.schema["n"], distinct.schema["vec"], *cells]))
    dealt = visits.join(cuts, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("stored_blocks", "asking_blocks")})
    own_i = F.pmod(F.xxhash64("rid"), F.col("stored_blocks")).cast("int")
    own_j = F.pmod(F.xxhash64(F.lit("asks"), "rid"), F.col("asking_blocks")).cast("int")
    to = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    column = F.transform(F.sequence(F.lit(0), F.col("stored_blocks") - 1), lambda i: to(i, own_j))
    row = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("asking_blocks") - 1), lambda j: to(own_i, j)))
    blocks = dealt.select(*key, "rid", "n", "vec", "home", own_i.alias("own_i"), own_j.alias("own_j"), F.explode(F.array_union(column, F.coalesce(row, F.array().cast("array<struct<i:int,j:int>>")))).alias("at"))
    flagged = blocks.select(*key, "at.i", "at.j", "rid", "n", "vec", (F.col("home") & (F.col("at.i") == F.col("own_i"))).alias("as_data"), (F.col("at.j") == F.col("own_j")).alias("as_query"))
    return flagged.groupBy(*key, "i", "j").applyInArrow(_verified(threshold), "rid long, links long, other long")


def index_of(distinct: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> Index | None:
    """The index for all ``distinct`` vectors, from a sample by hash; None if there are none."""
    longest, largest = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).agg(F.max("size"), F.max("n")).first()
    if longest is None:
        return None
    most = max(64, min(SAMPLE, SAMPLE_NUMBERS // longest))
    width = min(longest, SAMPLE_NUMBERS // 64)
    sample = distinct.select(F.slice("vec", 1, width).alias("vec")).orderBy(F.xxhash64("vec")).limit(most).toArrow()
    return fit(units(sample.column("vec"), width), largest, threshold, recall)


def report(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows = usable(embeddings).select("vec_id", "label", "own")
    distinct = distinct_vectors(embeddings)
    index = index_of(distinct, threshold, recall)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = durable(linked(distinct, index, threshold, block))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    named = durable(distinct.select("label", wide_hash(F.col("vec")).alias("own"), "least", "n", "rid").join(links, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    result = named.join(least, "root").select("label", "own", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    out = rows.join(result, ["label", "own"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
