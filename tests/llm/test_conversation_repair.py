"""Repair against a search over all edits, conversation by conversation."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import defaultdict

import pytest

from barloom.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows) -> tuple[int, str, str]:
    """Dijkstra over (row, state) with the whole audit as the second key."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if k == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (k, state) in done:
            continue
        done.add((k, state))
        roles = {"u": "user", "a": "assistant"}
        for r, name in roles.items():
            if (state, r) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", k, NEXT[state, r], [*lines, f"{name}:"]))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, NEXT[state, role[:1]], [*lines, f"{role}:{text}"]))
                for r, name in roles.items():
                    if (state, r) in NEXT:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, NEXT[state, r], [*lines, f"{name}:{text}"]))
    raise AssertionError


def plain(table) -> list[tuple]:
    kept, ids = defaultdict(list), set()
    for conv_id, turn, role, text in table:
        ids.add(conv_id)
        role, text = " " if role is None else role, " " if text is None else text
        name = " " if conv_id is None else conv_id
        kind = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept[conv_id] += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for c in ids:
        rows = sorted(kept[c], key=lambda r: (r[0] is not None, r[0] or 0))
        seen, told, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            told.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, text = cheapest(told)
        out.append((c, gaps, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows) -> list[tuple]:
    return sorted((tuple(r) for r in conversation_repair.report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_steps_against_a_search():
    """Every signature of up to five rows: what the automaton says and what the search says."""
    import itertools

    import pyarrow as pa

    letters = {"x": ("user", "blank"), "s": ("system", None), "u": ("user", None), "a": ("assistant", None), "o": ("tool", None), "U": ("user", "truncated"), "A": ("assistant", "truncated"), "O": ("tool", "truncated"), "S": ("system", "truncated")}
    tails = sorted("".join(t) for n in range(1, 6) for t in itertools.islice(itertools.product(letters, repeat=n), 0, None, 1 if n < 4 else 7 if n == 4 else 61))
    table = pa.RecordBatch.from_arrays([pa.array(tails)], ["tail"])
    for batch in conversation_repair._solved(iter([table])):
        for tail, cost, audit in zip(*(c.to_pylist() for c in batch.columns)):
            want = cheapest([(letters[s][0], "t", letters[s][1]) for s in reversed(tail)])
            assert (cost, audit) == want[:2], tail


def test_conversations_of_all_kinds(spark):
    roles = ["system", "user", "assistant", "tool", "", "a", "user"]
    rows = []
    for c in range(150):
        for t in range(c % 9):
            x = zlib.crc32(f"{c} {t}".encode())
            role = ("user", "assistant")[t % 2] if x % 3 else roles[x % 7]
            rows.append((c, t + (x % 5 == 0), role, ("Text.", "Done!\n", "no end", "é?", "...", "Text.")[x // 7 % 6] + ("" if x % 4 else str(t))))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert found(spark, rows) == plain(rows)


def test_nulls_blanks_and_long_conversations(spark):
    rows = [(1, None, None, None), (1, 4, "user", "Hi."), (2, 0, "user", None), (2, 1, None, "x."), (3, None, "user", "a."), (None, 0, "user", "who."), (None, 3, "assistant", "me."), (4, 0, "user", "word " * 100_000 + "."), (4, 1, "assistant", "　"), (5, 0, "user", " \n\x0b"), (6, -2, "assistant", "a."), (6, 2, "user", "b?")]
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [2, 5])
def test_repeated_rows_are_duplicates(spark, n):
    rows = [(9, 1, "user", "Same.")] * n + [(9, 2, "assistant", "Other.")]
    assert found(spark, rows) == plain(rows)


def test_empty_table_other_columns_and_nothing_left(spark):
    assert found(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x"), (gone + 1, 0, "user", "y.")]
    df = spark.createDataFrame([(*r, "t", 1, "k") for r in rows], SCHEMA + ", tail string, at int, own string")
    got = sorted((tuple(r) for r in conversation_repair.report(df).collect()), key=str)
    assert got == plain(rows)
    assert next(r for r in got if r[0] == gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
