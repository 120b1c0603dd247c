import hashlib
import random

import pytest

from barloom.llm import fingerprints
from tests.llm.conftest import PROSE, clashing


def text_of(rng, n):
    return " ".join(rng.choice(PROSE.split()) + rng.choice(["", "s", "é", "日本"]) for _ in range(n))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode() if r[1] is not None else b""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        own, other, following = (fingerprints.chunks(x.encode()) for x in (t, changed, nxt))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.encoded(own), fingerprints.encoded(other), fingerprints.likeness(own, other), fingerprints.likeness(own, following)))
    return sorted(out, key=str)


def test_report_against_brute_force(docs):
    rng = random.Random(1)
    rows = [(k * 3 % 101, text_of(rng, rng.randrange(0, 200))) for k in range(101)] + [(300, None), (301, ""), (302, "x"), (-5, "🙂" * 50), (400, text_of(rng, 20_000)), (None, "no id")]
    for runs in (None, 1, 7):
        assert sorted((tuple(r) for r in fingerprints.report(clashing(docs(rows)).repartition(5), runs).collect()), key=str) == brute(rows)


def test_odd_rows(docs, odd, none):
    assert fingerprints.report(odd).count() == odd.count() and fingerprints.report(none).count() == 0
    alone = fingerprints.report(docs([(1, PROSE)])).first()
    assert alone.near_next == 1.0
    same = fingerprints.report(docs([(1, PROSE), (2, PROSE), (3, PROSE)])).collect()
    assert {r.near_next for r in same} == {1.0} and len({r.fingerprint for r in same}) == 1
    assert {r.fingerprint for r in fingerprints.fingerprint(docs([(1, None), (2, "")])).collect()} == {""}


def test_ids_that_are_no_numbers(spark):
    named = spark.createDataFrame([("a", PROSE), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in fingerprints.fingerprint(named).collect()} == {"a", None}
    with pytest.raises(TypeError):
        fingerprints.report(named)


def test_chunks_cover_and_survive_shifts():
    rng = random.Random(8)
    text = text_of(rng, 3000).encode()
    cuts = fingerprints.cuts(text)
    sizes = [b - a for a, b in zip([0, *cuts], cuts)]
    assert cuts[-1] == len(text) and max(sizes) <= fingerprints.MOST and min(sizes[:-1]) > fingerprints.LEAST
    found = fingerprints.chunks(text)
    assert sum(found.values()) == len(text) and fingerprints.decoded(fingerprints.encoded(found)) == found
    shifted = b"an insertion at the start " + text
    assert fingerprints.likeness(found, fingerprints.chunks(shifted)) > 0.98
    assert fingerprints.likeness(fingerprints.chunks(text[5000:9000]), found) > 0.9  # contained, though far smaller
    assert fingerprints.likeness(found, fingerprints.chunks(text_of(rng, 3000).encode())) < 0.2
    assert fingerprints.likeness({}, {}) == 1.0 and fingerprints.likeness({}, found) == fingerprints.likeness(found, {}) == 0.0
