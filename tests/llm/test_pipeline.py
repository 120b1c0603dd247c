import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from barloom.llm import decontaminate, mixing, quality, queries, sharding, simhash

from tests.llm.conftest import clashing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's documents on the smallest tables."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], SF).cache())
    return docs


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_each_stage_does_its_operator_on_all_it_gets(spark, stages):
    first, good, single, clean, mixed, sharded = stages
    assert all(s.columns == first.columns for s in stages[:-1])
    scores = quality.classify(first, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids(good) == sorted(r.doc_id for r in scores if r.predicted)
    groups = simhash.report(good).collect()
    assert ids(single) == sorted({r.component_id for r in groups})
    found = decontaminate.report(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert ids(clean) == sorted(r.doc_id for r in found if not r.contaminated)
    copies = mixing.report(clean).collect()
    assert ids(mixed) == sorted(r.doc_id for r in copies for _ in range(r.copies)) and min(r.copies for r in copies) == 1
    assert ids(sharded) == ids(mixed) and set(sharded.columns) == {*first.columns, "shard", "vslot"}
    slots = sharding.slot_map(sharding.slot_totals(sharding.sizes(mixed)))
    assert {(r.vslot, r.shard) for r in sharded.collect()} <= {(r.vslot, r.shard) for r in slots.collect()}


def test_run_is_the_stages_in_order(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.shard) for r in out.collect()) == sorted((r.doc_id, r.shard) for r in stages[-1].collect())
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns; then an empty table."""
    rows = clashing(odd)
    for docs in (rows, clashing(none)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == rows.columns
            docs = spark.createDataFrame(docs.collect(), rows.schema)  # as if written and read again
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.columns == [*rows.columns, "shard", "vslot_"] and last.count() == docs.count()
    # near copies stay once whatever their ids, and rows without id or text aren't lost but to the classifier
    single = corpus_pipeline.near_dedup(spark, rows, SF)
    kept = sorted({(r.text or "").strip().lower()[:40] for r in single.collect()})
    assert kept == sorted({(r.text or "").strip().lower()[:40] for r in rows.collect()}) and single.count() < rows.count()


def test_registered_queries():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted((tuple(r) for r in cursor.fetchall()), key=repr)
    out = queries.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted((tuple(r) for r in out.select(columns).collect()), key=repr) == want
