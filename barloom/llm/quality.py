"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees over binned features leaves one lookup table per feature and one
grid per chosen pair. A score is the sum of table entries, so whole batches are scored by a few
array additions. Features come from the whole text only.

Defined cases: a null text is an empty one and gets a score too; rows with a null id are never held
out and never learnt from; labels that are null or repeated with different values are left out;
without two classes among the labels every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import bodies, fresh_name, wide_hash

FEATURES = (
    "log_bytes", "log_words", "upper", "digit", "other_ascii", "pipe", "bang", "noise", "sentence", "comma", "high", "newline",
    "distinct_words", "repeat_words", "word_length", "word_spread", "byte_entropy", "distinct_lines", "line_length", "clean_ends",
)
MAX_TRAINING_ROWS = 20_000  #: labelled rows that the model is fitted on at most, taken by a hash of the id
THRESHOLD = 0.3

_OF = {
    "upper": range(65, 91), "letters": [*range(65, 91), *range(97, 123)], "digit": range(48, 58), "pipe": b"|", "bang": b"!",
    "noise": b"#$%&*@^~", "sentence": b".?", "comma": b",;:", "newline": b"\n", "space": b" \t\r\v\f", "high": range(128, 256),
}
_NAMES = tuple(_OF)
_MASKS = np.array([[b in set(v) for b in range(256)] for v in _OF.values()], dtype=np.float64)


def features(text: bytes | None) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    text = text or b""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    has = dict(zip(_NAMES, (_MASKS @ counts).tolist()))
    share = counts[counts > 0] / max(n, 1)
    words = text.split()
    k = len(words)
    lines = text.split(b"\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=k)
    letters = has["letters"] + has["high"]
    other = n - sum(has[x] for x in ("letters", "digit", "pipe", "bang", "noise", "sentence", "comma", "newline", "space", "high"))
    return [
        float(np.log1p(n)), float(np.log1p(k)), has["upper"] / max(letters, 1), has["digit"] / max(n, 1), other / max(n, 1),
        has["pipe"] / max(k, 1), has["bang"] / max(k, 1), has["noise"] / max(k, 1), has["sentence"] / max(k, 1), has["comma"] / max(k, 1), has["high"] / max(n, 1), has["newline"] / max(k, 1),
        len(set(words)) / max(k, 1), sum(map(eq, words, words[1:])) / max(k - 1, 1), float(lengths.mean()) if k else 0.0, float(lengths.std()) if k else 0.0,
        float(-(share * np.log2(share)).sum()), len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), (letters + has["digit"]) / max(n - has["space"] - has["newline"], 1),
    ]


def _stumps(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 2.0) -> np.ndarray:
    """Newton steps of a tree of up to ``leaves`` leaves over ordered bins."""
    cuts = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = gain_of(a, at) + gain_of(at, b) - gain_of(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(at[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four blocks: its gain over one block, and the Newton steps."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    block = lambda c, a, b, d, e: c[b, e] - c[a, e] - c[b, d] + c[a, d]
    m, n = g.shape
    total = np.zeros((m - 1, n - 1))
    for a, b, d, e in ((0, i, 0, j), (0, i, j, n), (i, m, 0, j), (i, m, j, n)):
        total = total + block(cg, a, b, d, e) ** 2 / (block(ch, a, b, d, e) + ridge)
    at = np.unravel_index(int(total.argmax()), total.shape)
    x, y = int(at[0]) + 1, int(at[1]) + 1
    out = np.zeros_like(g)
    for a, b, d, e in ((0, x, 0, y), (0, x, y, n), (x, m, 0, y), (x, m, y, n)):
        out[a:b, d:e] = block(cg, a, b, d, e) / (block(ch, a, b, d, e) + ridge)
    return float(total[at] - cg[m, n] ** 2 / (ch[m, n] + ridge)), out


class AdditiveModel:
    """Lookup tables per feature and per pair of features, with the cut points that bin them."""

    def __init__(self, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple[int, int]], grids: list[np.ndarray], start: float) -> None:
        self.cuts, self.tables, self.pairs, self.grids, self.start = cuts, tables, pairs, grids, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1 for the rows of ``x``."""
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        raw = np.full(len(x), self.start)
        for t, b in zip(self.tables, bins):
            raw += t[b]
        for (i, j), grid in zip(self.pairs, self.grids):
            raw += grid[bins[i], bins[j]]
        return 1 / (1 + np.exp(-raw))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, max_bins: int = 48, rounds: int = 120, n_pairs: int = 6, pair_rounds: int = 40, rate: float = 0.12) -> AdditiveModel:
        """Boosts one feature after another, round after round; then the pairs with most to gain."""
        share = float(y.mean()) if len(y) else 0.5
        none = [np.empty(0) for _ in FEATURES]
        if not len(y) or not 0 < share < 1:
            limit = min(max(share, 1e-6), 1 - 1e-6)
            return cls(none, [np.zeros(1) for _ in FEATURES], [], [], float(np.log(limit / (1 - limit))))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) for f in range(x.shape[1])]
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)]
        tables = [np.zeros(len(c) + 1) for c in cuts]
        raw = np.full(len(y), np.log(share / (1 - share)))

        def step() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-raw))
            return y - p, p * (1 - p)

        for _ in range(rounds):
            for f, b in enumerate(bins):
                g, h = step()
                add = rate * _stumps(np.bincount(b, g, len(tables[f])), np.bincount(b, h, len(tables[f])))
                tables[f] += add
                raw += add[b]
        g, h = step()
        grid_of = lambda i, j, w: np.bincount(bins[i] * len(tables[j]) + bins[j], w, len(tables[i]) * len(tables[j])).reshape(len(tables[i]), len(tables[j]))
        gains = [(-_quadrants(grid_of(i, j, g), grid_of(i, j, h))[0], i, j) for i in range(len(bins)) for j in range(i) if len(tables[i]) > 1 and len(tables[j]) > 1]
        pairs = [(i, j) for _, i, j in sorted(gains)[:n_pairs]]
        grids = [np.zeros((len(tables[i]), len(tables[j]))) for i, j in pairs]
        for _ in range(pair_rounds):
            for k, (i, j) in enumerate(pairs):
                g, h = step()
                add = rate * _quadrants(grid_of(i, j, g), grid_of(i, j, h))[1]
                grids[k] += add
                raw += add[bins[i], bins[j]]
        return cls(cuts, tables, pairs, grids, float(np.log(share / (1 - share))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, texts in bodies(batch.column("text")):
            rows = [features(t) for t in texts]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, len(rows)) for c in keep), pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fits on up to ``max_rows`` labelled documents outside the held-out fifth.

    The sample is the rows whose id hashes lowest, so it doesn't depend on how the table is dealt
    out. Its ids (``max_rows`` at most) are broadcast to pick the texts in one scan, and of the rows of an
    id the one whose text hashes lowest is learnt from.
    """
    agreed = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    )
    chosen = agreed.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    light = picked.select("doc_id", F.col("label").cast("double").alias("label"), wide_hash(F.col("text")).alias("own"), "text")
    schema = T.StructType([*light.schema[:3], T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = light.mapInArrow(_features, schema).groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("x", "own").alias("x")).select("label", "x").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, rows["label"]))  # the fit doesn't depend on the order of arrival
    return AdditiveModel.fit(x[order], rows["label"].to_numpy(dtype=np.float64)[order])


def _scorer(shared, texts: str, name: str, keep: list[str]):
    """Batches with the columns ``keep`` and the score of the column ``texts``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(np.array([features(t) for t in part])) for _, part in bodies(batch.column(texts))]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], [*keep, name])

    return scored


def with_score(documents: DataFrame, model: AdditiveModel) -> tuple[DataFrame, str]:
    """``documents`` with all their columns and one more, and its name: the chance of label 1."""
    name = fresh_name(documents, "score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema, T.StructField(name, T.DoubleType())])
    return documents.mapInArrow(_scorer(shared, "text", name, documents.columns), schema), name


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, max_rows))
    schema = T.StructType([documents.schema["doc_id"], T.StructField("score", T.DoubleType())])
    out = documents.select("doc_id", "text").mapInArrow(_scorer(shared, "text", "score", ["doc_id"]), schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
