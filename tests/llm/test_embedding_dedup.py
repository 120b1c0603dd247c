"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold: float = 0.98) -> list[tuple]:
    usable = [(k, np.array(v, dtype=float)) for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for i, (a, x) in enumerate(usable):
        for b, y in usable[i + 1 :]:
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
                links[b].add(a)
    out = []
    for k in links:
        seen, left = {k}, [k]
        while left:
            for o in links[left.pop()] - seen:
                seen.add(o)
                left.append(o)
        component = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), component, rows[k][0] == component))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, **how) -> list[tuple]:
    return sorted((tuple(r) for r in embedding_dedup.report(spark.createDataFrame(rows, schema), **how).collect()), key=str)


def clusters(n: int, width: int = 16, spread: float = 0.03, seed: int = 3) -> list[tuple]:
    """Near copies of a few vectors, one of them with a third of all rows, at distances on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((12, width))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    rows = []
    for k in range(n):
        m = 0 if k % 3 == 0 else int(rng.integers(0, 12))
        v = middles[m] + spread * rng.standard_normal(width) * (1 + k % 3)
        rows.append((k, np.float32(v * (1 + k % 5)).tolist(), m % 4))
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_against_all_pairs(spark, block):
    rows = clusters(400)
    assert found(spark, rows, recall=1, block=block) == plain(rows)


def test_the_index_finds_nearly_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "OCCUPANCY", 4)
    rows = clusters(900, width=24, spread=0.025)
    want, got = plain(rows), found(spark, rows)
    assert sum(r[1] for r in want) > 10_000
    assert 0.99 * sum(r[1] for r in want) <= sum(r[1] for r in got) <= sum(r[1] for r in want)


def test_an_exact_reach_misses_nothing_in_small_cells():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.06 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (x * y).sum(axis=1) >= 0.98
    index = embedding_dedup.fit(x, 30_000, recall=1)
    assert len(index.books[0]) > 15 and near.sum() > 500
    total = np.zeros(len(x))
    for part, book in ((slice(0, index.cut), index.books[0]), (slice(index.cut, None), index.books[1])):
        total += embedding_dedup.ways(x[:, part], book)[np.arange(len(x)), embedding_dedup.squared(y[:, part], book).argmin(axis=1)]
    assert (total[near] <= index.reach).all()


def test_traversal_visits_the_nearest_cells_in_order():
    rng = np.random.default_rng(1)
    first, second = (np.sort(rng.random((40, k)), axis=1) for k in (7, 5))
    seen = {}
    for rows, i, j in embedding_dedup.traversal(first, second, 0.6):
        for r, a, b in zip(rows.tolist(), i.tolist(), j.tolist()):
            seen.setdefault(r, []).append((first[r, a] + second[r, b], a, b))
    for r in range(40):
        every = sorted((first[r, a] + second[r, b], a, b) for a in range(7) for b in range(5))
        assert seen.get(r, []) == [x for x in every if x[0] <= 0.6]


def test_what_links_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, one, 0), (3, [2.0, 4.0, 6.0], 0), (4, one, 1), (5, one, None), (6, None, 0), (7, [], 0), (8, [0.0, 0.0, 0.0], 0), (9, [0.0, -0.0, 0.0], 0), (10, [1.0, None, 3.0], 0)]
    rows += [(11, [1.0, nan, 3.0], 0), (12, [1.0, inf, 3.0], 0), (13, [1.0, 2.0], 0), (14, [1.0, 2.0, 3.0, 0.0], 0), (None, one, 0), (2, one, 0), (None, [9.0, -1.0, 0.0], 3), (None, [9.0, -1.0, 0.0], 3)]
    assert found(spark, rows) == plain(rows)


def test_negative_zero_huge_and_tiny_numbers(spark):
    rows = [(1, [0.0, 1.0], 0), (2, [-0.0, 1.0], 0), (3, [1e300, 1e300], 0), (4, [1e-300, 1e-300], 0), (5, [1e-320, 0.0], 0)]
    got = {r[0]: r[1:] for r in found(spark, rows, "vec_id long, embedding array<double>, label int")}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True)}


def test_empty_table_other_columns_and_labels_of_text(spark):
    assert found(spark, []) == []
    rows = clusters(40)
    df = spark.createDataFrame([(*r[:2], f"label {r[2]}", 7, "o") for r in rows], "vec_id long, embedding array<float>, label string, rid long, own string")
    assert sorted((tuple(r) for r in embedding_dedup.report(df, recall=1).collect()), key=str) == plain(rows)
