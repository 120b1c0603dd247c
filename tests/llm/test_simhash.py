import random
import re

import numpy as np
import pytest
import xxhash
from barloom.llm import simhash
from barloom.llm.shared import connected_components
from tests.llm.conftest import clashing


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, f"{prints[k]:016x}", least.get(top(k))) for k, (i, _) in enumerate(rows)), key=str)


def test_report_against_brute_force(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    rows = []
    for k in range(40):
        text = [word() for _ in range(rng.randrange(0, 400))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(k % 5):
            edited = list(text)
            for _ in range(rng.randrange(0, 4)):
                if edited:
                    edited[rng.randrange(len(edited))] = word()
            rows.append((len(rows), "  ".join(edited).upper() if k % 2 else "\n".join(edited)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "ONE"), (505, "one two"), (None, "one"), (None, "unlike all the others"), (3, rows[3][1]), (503, "Ünï çödé 日本 語 🙂")]
    assert sorted((tuple(r) for r in simhash.report(clashing(docs(rows))).collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("bucket", "n"), [(20_000, 3000), (15, 800)])
def test_links_connect_what_all_pairs_connect(spark, bucket, n):
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, 25, dtype=np.int64)
    rows = []
    for k in range(n):  # dense groups, and chains between them
        x = int(centres[k % 25]) if k % 3 else int(rng.integers(0, 2**63))
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        rows.append(x - 2**64 if x >= 2**63 else x)
    rows = sorted(set(rows))
    x = np.array(rows, dtype=np.int64).view(np.uint64)
    root = {r: r for r in rows}

    def top(r):
        while root[r] != r:
            r = root[r]
        return r

    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 3):
            u, v = top(rows[a]), top(rows[b])
            root[max(u, v)] = min(u, v)
    edges = simhash.links(spark.createDataFrame([(r,) for r in rows], "fp long"), bucket=bucket)
    assert edges.count() < 40 * n
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert {r: found.get(r, r) for r in rows} == {r: top(r) for r in rows}


def test_plan_covers_every_pair():
    rng = np.random.default_rng(2)
    both = rng.random((64, 64)) * 1000
    both = (both + both.T) / 2
    for n in (0, 10, 10**6, 10**9):
        parts = simhash.plan(n, both if n else both * 0)
        bits = [b for g, _ in parts for b in g]
        assert len(bits) == len(set(bits))
        x = rng.integers(0, 2**63, 500).astype(np.uint64)
        y = x.copy()
        for _ in range(3):
            y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
        met = np.zeros(500, dtype=bool)
        for g, t in parts:
            met |= np.bitwise_count(simhash._packed(x, g) ^ simhash._packed(y, g)) <= t
        assert met.all()


def test_keep_one(docs, odd, none):
    frame = clashing(docs([(7, "a b c d e"), (3, "A b c  d e"), (3, "a b c d e"), (9, "quite another text here"), (None, "a b c d e")]))
    out = simhash.keep_one(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [3, 9]
    assert simhash.report(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert simhash.report(odd).count() == odd.count()


def test_keep_one_decides_by_row(docs):
    ten = [f"{w} {w}{w} text of its own, unlike the {w} others" for w in ("red", "oak", "sun")]
    rows = [(None, ten[0]), (None, ten[1]), (None, ten[2]), (None, ten[2]), (1, ten[1].upper())]  # null ids, one near to an id
    rows += [(5, "five words that stand alone"), (5, "a b c d e"), (2, "A b c d e"), (6, "two texts of one id"), (6, "and neither has any copy")]
    rows += [(8, "a row that comes twice"), (8, "a row that comes twice")]
    frame = clashing(docs(rows))
    for dealt in (frame, frame.repartition(3)):
        out = simhash.keep_one(dealt)
        assert out.columns == frame.columns
        want = [(None, ten[0]), (None, ten[2]), (1, ten[1].upper()), (2, "A b c d e"), (5, "five words that stand alone"), (6, "two texts of one id"), (6, "and neither has any copy"), (8, "a row that comes twice")]
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {**{k: 0 for k in range(201)}, 500: 500}
