"""Tables by key: rows that move, null partitions, lost loads and loads at once."""

from __future__ import annotations

import pytest

from barloom.sources import keyed_table

SCHEMA = "k int, market string, v string, n int"


def load(spark, path, rows, schema=SCHEMA, keys=("k",)) -> int:
    return keyed_table.upsert(spark.createDataFrame(rows, schema), path, list(keys), ["n"], "market")


def rows(spark, path, version=None) -> list[tuple]:
    return sorted((tuple(r) for r in keyed_table.current(spark, path, version).collect()), key=str)


def test_null_partitions_keep_what_a_load_leaves(spark, tmp_path):
    path = str(tmp_path / "t")
    for part in ([(1, None, "a", 0)], [(2, None, "b", 0)], [(1, None, "c", 0)]):
        load(spark, path, part)
    assert rows(spark, path) == [(1, None, "c"), (2, None, "b")]


def test_a_key_moves_to_another_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [(1, "x", "a", 0), (2, "x", "b", 0), (3, "z", "c", 0)])
    before = keyed_table.manifest(spark, path)["rows"]
    load(spark, path, [(1, "y", "d", 0), (1, "w", "late", 1), (4, None, "e", 0)])
    assert rows(spark, path) == [(1, "w", "late"), (2, "x", "b"), (3, "z", "c"), (4, None, "e")]
    load(spark, path, [(1, None, "f", 0), (2, None, "g", 0)])
    assert rows(spark, path) == [(1, None, "f"), (2, None, "g"), (3, "z", "c"), (4, None, "e")]
    after = keyed_table.manifest(spark, path)["rows"]
    z = next(p for p in before if bytes.fromhex(p[2:]) == b"z")
    assert after[z] == before[z] and len(after) == 2  # what no load touched is the same piece, and x is gone
    assert rows(spark, path, 1) == [(1, "x", "a"), (2, "x", "b"), (3, "z", "c")]  # earlier versions can be read


def test_null_and_several_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, j string, market string, v string, n int"
    load(spark, path, [(None, "a", "x", "1", 0), (1, None, "x", "2", 0), (1, "a", "x", "3", 0)], schema, ("k", "j"))
    load(spark, path, [(None, "a", "y", "4", 0), (1, None, None, "5", 0)], schema, ("k", "j"))
    assert rows(spark, path) == [(1, "a", "x", "3"), (1, None, None, "5"), (None, "a", "y", "4")]


def test_odd_names_of_partitions_and_an_empty_load(spark, tmp_path):
    path = str(tmp_path / "t")
    odd = ["", "null", "a/b", "a=b", "ü %", "__HIVE_DEFAULT_PARTITION__"]
    load(spark, path, [(k, m, "v", 0) for k, m in enumerate(odd)])
    load(spark, path, [])
    assert [r[1] for r in rows(spark, path)] == odd


def test_a_lost_load_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [(1, "x", "a", 0), (2, "y", "b", 0)])
    keyed_table.stage(spark.createDataFrame([(1, "y", "lost", 0), (3, "x", "lost", 0)], SCHEMA), path, ["k"], ["n"], "market")  # and not published
    assert rows(spark, path) == [(1, "x", "a"), (2, "y", "b")]
    assert load(spark, path, [(1, "y", "c", 0)]) == 2
    assert keyed_table.vacuum(spark, path) > 0
    assert rows(spark, path) == [(1, "y", "c"), (2, "y", "b")]
    assert keyed_table.vacuum(spark, path) == 0
    load(spark, path, [(2, "x", "d", 0)])
    assert rows(spark, path) == [(1, "y", "c"), (2, "x", "d")]


def test_of_two_loads_at_once_both_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    load(spark, path, [(1, "x", "a", 0)])
    real, other = keyed_table._publish, []

    def late(session, at, new):
        if not other:  # another load gets in between staging and publishing
            other.append(new["version"])
            monkeypatch.setattr(keyed_table, "_publish", real)
            load(spark, path, [(2, "x", "other", 0), (1, "y", "other", 0)])
            monkeypatch.setattr(keyed_table, "_publish", late)
        return real(session, at, new)

    monkeypatch.setattr(keyed_table, "_publish", late)
    assert load(spark, path, [(1, "x", "mine", 0), (3, "z", "mine", 0)]) == 3 and other == [2]
    assert rows(spark, path) == [(1, "x", "mine"), (2, "x", "other"), (3, "z", "mine")]


def test_other_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    load(spark, path, [(1, "x", "a", 0)])
    with pytest.raises(ValueError, match="has the keys"):
        load(spark, path, [(1, "x", "a", 0)], keys=("k", "v"))
