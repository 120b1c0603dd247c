import zlib

import numpy as np
from barloom.llm import quality
from tests.llm.conftest import PROSE, clashing


def corpus(docs, spark, n=400):
    rows, labels = [], []
    for k in range(n):
        good = k % 4 > 0
        words = [PROSE.split()[(k * 7 + j * (3 + k % 5)) % 23] + str((k * j) % 17) * (j % 3 == 0) for j in range(20 + k % 60)]
        rows.append((k, " ".join(words) + "." if good else " ".join(w + "%%%" for w in words) if k % 8 else " | ".join(words[:3] * 9)))
        labels.append((k, int(good), 0))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    frame, labels = corpus(docs, spark)
    rows = {r.doc_id: r for r in quality.classify(frame, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(rows[i].held_out == (i in set(held)) for i in rows)
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())


def test_held_out_labels_and_other_columns_do_not_matter(spark, docs):
    frame, labels = corpus(docs, spark)
    one = {r.doc_id: r.score for r in quality.classify(frame, labels).collect()}
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.quality, 1) for r in labels.collect()], labels.schema)
    two = {r.doc_id: r.score for r in quality.classify(clashing(frame).repartition(3), flipped).collect()}
    assert one == two


def test_odd_rows(spark, docs, odd, none):
    frame, labels = corpus(docs, spark, 80)
    model = quality.train(frame, labels)
    scored, name = quality.with_score(clashing(odd), model)
    assert name == "score_" and scored.count() == odd.count() and scored.where(f"{name} between 0 and 1").count() == odd.count()
    assert quality.classify(none, labels).count() == 0
    nothing = quality.classify(odd, spark.createDataFrame([], labels.schema)).collect()
    assert {r.score for r in nothing} == {0.5} and len(nothing) == odd.count()
    disagreeing = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (5, None, 0)], labels.schema)
    assert {r.score for r in quality.classify(odd, disagreeing).collect()} == {0.5}


def test_pairs_are_learnt():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel.fit(x, y)
    assert (1, 0) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_an_id_of_many_rows_is_learnt_from_once(spark, docs, monkeypatch):
    frame, labels = corpus(docs, spark)
    hot = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5)
    more = frame.union(docs([(hot, f"{PROSE} {k}") for k in range(300)]))
    seen = []
    monkeypatch.setattr(quality.AdditiveModel, "fit", classmethod(lambda cls, x, y: seen.append((x, y))))
    for table in (more, more.repartition(5)):
        quality.train(table, labels)
    assert len(seen[0][0]) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(400))
    assert all(np.array_equal(a, b) for a, b in zip(*seen))
    quality.train(more, labels, max_rows=50)
    assert len(seen[2][0]) == len(seen[2][1]) == 50
