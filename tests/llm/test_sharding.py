import zlib

import pytest
from barloom.llm import sharding
from tests.llm.conftest import clashing


def rows_of(frame):
    return [r.asDict() for r in frame.collect()]


def test_bytes_are_even_and_slots_gapless(spark, docs):
    frame = docs([(k, "x" * (k * 37 % 900)) for k in range(600)])
    rows = rows_of(sharding.shard(frame, 24))
    loads = {}
    for r in rows:
        loads.setdefault(r["shard"], []).append(r)
        text = "x" * (r["doc_id"] * 37 % 900)
        assert r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text.encode()) and r["grown_shard"] is None
    assert sorted(loads) == list(range(24)) and len(rows) == 600
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in loads.values())
    sums = [sum(x["size"] for x in v) for v in loads.values()]
    assert max(sums) < 1.02 * min(sums)


def plain(rows, shards, n_slots):
    """Each shard's bytes and rows, and the rows of each slot, by a plain walk: slots dealt in turn, then moved
    from the heaviest to the lightest shard while that helps."""
    loads = [[0, 0] for _ in range(n_slots)]
    for r in rows:
        loads[r["vslot"]][0] += r["size"]
        loads[r["vslot"]][1] += 1
    home = [v % shards for v in range(n_slots)]
    total = lambda s: sum(loads[v][0] for v in range(n_slots) if home[v] == s)
    while True:
        sums = [total(s) for s in range(shards)]
        top, low = sums.index(max(sums)), sums.index(min(sums))
        gap = sums[top] - sums[low]
        fits = [v for v in range(n_slots) if home[v] == top and 0 < loads[v][0] < gap]
        if sums[top] <= sum(sums) / shards * (1 + sharding.TOLERANCE) or not fits:
            return home
        home[min(fits, key=lambda v: (abs(loads[v][0] - gap / 2), v))] = low


def test_placement_against_a_plain_walk(spark, docs, tmp_path):
    rows = [(k % 70, "z" * (k * 31 % 400)) for k in range(300)] + [(None, "same"), (None, None), (None, None)]
    out = rows_of(sharding.shard(docs(rows), 5, 64, None))
    home = plain(out, 5, 64)
    assert all(r["shard"] == home[r["vslot"]] and r["map_version"] == 1 for r in out)
    for s in range(5):
        mine = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        order = [(r["vslot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]) for r in mine]
        assert order == sorted(order)
    sizes = lambda xs: sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in xs), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sizes(rows)


def test_one_row_repeated_is_spread(docs):
    frame = docs([(7, "the same row " * 10)] * 12_000 + [(k, "x" * 100) for k in range(6_000)])
    loads = {}
    for r in rows_of(sharding.shard(frame, 6)):
        n, seen = loads.get(r["shard"], (0, set()))
        loads[r["shard"]] = (n + r["size"], seen | {r["slot"]})
    assert max(n for n, _ in loads.values()) < 1.02 * min(n for n, _ in loads.values())
    assert sum(len(s) for _, s in loads.values()) == 18_000 and all(s == set(range(len(s))) for _, s in loads.values())


def test_the_stored_map_is_edited(spark, docs, tmp_path):
    folder = str(tmp_path / "map")
    sharding.save_map(sharding.dealt_map(spark, 4, 256), folder)
    one = {r["doc_id"]: r for r in rows_of(sharding.shard(docs([(k, "y" * 50) for k in range(500)]), 4, 256, folder))}
    more = rows_of(sharding.shard(docs([(k, "y" * 50) for k in range(500)] + [(k, "y" * 90) for k in range(500, 560)]), 4, 256, folder))
    assert {r["map_version"] for r in one.values()} == {1} and {r["map_version"] for r in more} == {2}
    stayed = [r["shard"] == one[r["doc_id"]]["shard"] for r in more if r["doc_id"] in one]
    assert sum(stayed) > 0.8 * len(stayed)
    assert sorted(r.version for r in spark.read.parquet(folder).select("version").distinct().collect()) == [0, 1, 2]


def test_odd_rows(odd, none):
    rows = rows_of(sharding.shard(clashing(odd), 3))
    assert len(rows) == odd.count() and sorted(r["size"] for r in rows)[:2] == [8, 8]
    assert sharding.shard(none).count() == 0


def test_rebalance_moves_little_and_keeps_versions(spark, docs, tmp_path):
    first = docs([(k, "y" * (k % 50)) for k in range(500)])
    totals = sharding.slot_totals(sharding.sizes(first, 256))
    one = sharding.slot_map(totals, 4, 256)
    two = sharding.rebalance(one, totals, 5, 0.05)
    sharding.save_map(one, str(tmp_path))
    sharding.save_map(two, str(tmp_path))
    a, b = ({r.vslot: r.shard for r in sharding.load_map(spark, str(tmp_path), v).collect()} for v in (1, 2))
    assert sharding.load_map(spark, str(tmp_path)).first().version == 2
    moved = [v for v in a if a[v] != b[v]]
    assert moved and all(b[v] == 4 for v in moved)
    sums = [0] * 5
    for r in two.collect():
        sums[r.shard] += r.slot_bytes
    assert max(sums) <= 1.06 * sum(sums) / 5
    three = sharding.rebalance(two, totals, 3, 0.05)
    assert {r.shard for r in three.collect()} == {0, 1, 2} and three.first().version == 3


def test_place_rows_keeps_other_columns(odd):
    frame = clashing(odd)
    slots = sharding.slot_map(sharding.slot_totals(sharding.sizes(frame)), 5)
    out = sharding.place_rows(frame, slots)
    assert out.count() == frame.count() and out.columns == [*frame.columns, "shard", "vslot_"]
    assert {r.vslot for r in out.collect()} == {r.vslot for r in frame.collect()}


def test_a_map_of_another_number_of_slots_is_refused(spark, tmp_path):
    folder = str(tmp_path / "map")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)], "doc_id long, text string")
    sharding.save_map(sharding.dealt_map(spark, n_slots=1024), folder)
    assert sharding.shard(docs, n_slots=1024, folder=folder).count() == 300
    with pytest.raises(ValueError, match="1024 slots"):
        sharding.shard(docs, n_slots=4096, folder=folder)
    with pytest.raises(ValueError, match="1024 slots"):
        sharding.place_rows(docs, sharding.load_map(spark, folder), 4096)
    assert sharding.place_rows(docs, sharding.load_map(spark, folder), 1024).count() == 300
