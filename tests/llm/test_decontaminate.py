import hashlib
import random
import re

import pytest
from barloom.llm import decontaminate
from tests.llm.conftest import PROSE, clashing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(10, len(iw))
            for w in {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if n else ():
                for a in range(len(ws) - n + 1):
                    if tuple(ws[a : a + n]) == w:
                        hit.update(range(a, a + n))
                        found.add(item_id)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_against_brute_force(spark, docs, block_words):
    rng = random.Random(11)
    pick = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma9", "délta", "eps", "zeta"]) for _ in range(n))
    items = [(k, pick(rng.choice([2, 4, 9, 10, 11, 14, 30]))) for k in range(12)] + [(3, pick(12)), (None, pick(15)), (20, ""), (21, None), (22, "!!! ???")]
    rows = []
    for k in range(60):
        text = pick(rng.randrange(0, 60))
        if k % 3 == 0:
            item = items[k % len(items)][1] or ""
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "; " + item.upper() + " -- " + text[at:]
        rows.append((k, text))
    rows += [(100, None), (101, ""), (5, rows[5][1])]
    out = decontaminate.report(clashing(docs(rows)), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, items)


def test_empty_tables_and_odd_rows(spark, odd, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, PROSE)], nothing.schema)
    assert decontaminate.report(none, item).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontaminate.report(odd, nothing).collect()} == {(0, False)}
    frame = clashing(odd)
    kept = decontaminate.clean(frame, item)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 7, 8, 9}
    assert decontaminate.clean(frame, nothing).count() == frame.count()


def test_blocks_are_bounded_and_read_one_at_a_time(spark, docs, monkeypatch):
    item = " ".join(f"w{k}" for k in range(200))
    table = spark.createDataFrame([(1, item), (2, "short one"), (3, item + " end")], "item_id long, text string")
    lists = list(decontaminate.blocks(table, 50))
    assert all(sum(len(words(t.decode())) for _, t in x) < 50 + 10 for x in lists)
    cut = {(i, tuple(w[a : a + 10])) for x in lists for i, t in x for w in [words(t.decode())] for a in range(max(1, len(w) - 9))}
    assert cut == {(str(i), tuple(w[a : a + 10])) for i, t in [(1, item), (2, "short one"), (3, item + " end")] for w in [words(t)] for a in range(max(1, len(w) - 9))}
    log, real, rarity = [], decontaminate.blocks, decontaminate._rarity

    def told(*args):
        for x in real(*args):
            log.append("read")
            yield x

    monkeypatch.setattr(decontaminate, "blocks", told)
    monkeypatch.setattr(decontaminate, "_rarity", lambda *args: log.append("used") or rarity(*args))
    rows = [(1, item), (2, "a short one"), (3, " ".join(f"w{k}" for k in range(30, 75))), (4, "w1 w2 w3"), (5, None), (None, item), (1, item)]
    out = decontaminate.report(docs(rows), table, block_words=150)
    assert log[:2] == ["read", "read"] and log.count("read") == log.count("used") > 2 and "read,read,read" not in ",".join(log)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, [(1, item), (2, "short one"), (3, item + " end")])


def test_many_blocks_and_a_very_long_item(spark, docs):
    """An item far longer than a block, and a benchmark of some twenty blocks: the same hits."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(6000))
    items = [(1, long), *((k, " ".join(f"w{rng.randrange(400)}" for _ in range(25))) for k in range(2, 30))]
    ws = long.split()
    rows = [(k, " ".join([*ws[k * 170 : k * 170 + 8 + k], "gap", *items[1 + k % 20][1].split()[3:15]])) for k in range(30)]
    out = decontaminate.report(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_words=350)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, items)


def test_a_window_never_spans_two_documents(docs, spark):
    item = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(10)))], "item_id long, text string")
    halves = docs([(k, " ".join(f"w{k}" for k in part)) for k, part in enumerate([range(5), range(5, 10)] * 20)]).coalesce(1)
    assert not [r for r in decontaminate.report(halves, item).collect() if r.n_hit]
