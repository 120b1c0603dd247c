"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import pytest

from barloom.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows) -> list[tuple]:
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
        ends[tuple(whole)].add(c)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].add(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        (
            (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
            for k in members
        ),
        key=str,
    )


def found(spark, rows, **how) -> list[tuple]:
    return sorted((tuple(r) for r in conversation_trie.report(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def chats(n: int, length, alphabet: int = 3) -> list[tuple]:
    """Conversations that share many prefixes."""
    out = []
    for c in range(n):
        digits = zlib.crc32(f"chat {c}".encode())
        for t in range(length(c)):
            out.append((c, t, ("user", "assistant")[t % 2], f"é{digits // alphabet**(t % 12) % alphabet if c % 4 else 0}"))
    return out


@pytest.mark.parametrize("height, span", [(16, 4096), (2, 4096), (3, 4), (5, 2)])
def test_against_a_plain_trie(spark, height, span):
    rows = chats(60, lambda c: c % 11)
    assert found(spark, rows, height=height, span=span) == plain_trie(rows)


def test_deep_conversations_in_few_bands(spark):
    rows = chats(10, lambda c: 90 if c == 5 else 70 if c in (0, 9) else 12, alphabet=1)
    want = plain_trie(rows)
    assert max(r[1] for r in want) > 60
    assert found(spark, rows, height=4, span=16) == want


def test_nulls_repeats_and_gaps(spark):
    rows = [(0, None, None, None), (0, 5, "user", "x"), (0, -3, "", "y"), (1, 0, "user", None), (2, 7, None, "x"), (None, 0, "user", "x"), (7, 1, "user", "long " * 20_000), (13, 0, "a", "bc"), (14, 0, "ab", "c"), (-3, 0, "user", "x"), (-4, 0, "user", "x"), (-5, 2, "user", "q")]
    assert found(spark, rows) == plain_trie(rows)
    repeated = [(4, 1, "user", "x")] * 3 + [(6, 1, "user", "x")] * 2
    assert found(spark, repeated) == plain_trie(repeated)


def test_empty_table_and_other_columns(spark):
    assert found(spark, []) == []
    rows = chats(12, lambda c: 3)
    df = spark.createDataFrame([(*r, 1, "z", 0) for r in rows], SCHEMA + ", depth int, ka string, n int")
    assert sorted((tuple(r) for r in conversation_trie.report(df).collect()), key=str) == plain_trie(rows)


def test_many_ends_are_digested_in_pieces(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 500, 3)]
    want = plain_trie(rows)
    assert found(spark, rows) == want
    ends = spark.createDataFrame([(c, 1, 2) for c in range(-40, 500, 3)], "conv_id long, ka long, kb long")
    got = conversation_trie.end_digests(ends, block=16).collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(map(str, range(-40, 500, 3))).encode()).hexdigest()]
