import hashlib
import time
from collections import Counter

from barloom.llm import line_dedup
from tests.llm.conftest import clashing

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(SPACE)


def brute(rows, least=10):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs):
    rows = [(k, "\n".join([f"own {k}", [" All Rights\t", "all rights", "ALL RIGHTS\r"][k % 3], "", f"group {k // 9}", f"ten {k // 10}", "É" if k % 2 else "é", "all rights"][: 3 + k % 5])) for k in range(95)]
    rows += [(200, None), (201, ""), (202, "all rights"), (203, "all rights\nall rights"), (204, "\n".join(["all rights", "x"] * 4000)), (3, rows[3][1]), (3, rows[4][1]), (None, "all rights\nlast")]
    out = line_dedup.report(clashing(docs(rows)))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_dedup_keeps_columns_and_nulls(docs, odd, none):
    frame = clashing(docs([(k, f"a{k}\nshared") for k in range(10)] + [(None, None), (30, "shared")]))
    out = line_dedup.dedup(frame)
    assert out.columns == frame.columns and sorted((r.text for r in out.collect()), key=str) == sorted([*(f"a{k}" for k in range(10)), None, ""], key=str)
    assert line_dedup.report(odd).count() == odd.count() and line_dedup.report(none).count() == 0
    low = line_dedup.report(docs([(k, "\n") for k in range(12)]), min_length=0).collect()
    assert {r.n_dropped for r in low} == {2}


def test_a_million_different_lines_in_one_text(spark):
    lines = [f"line {k}" for k in range(1_000_000)]
    rows = [(1, "\n".join(lines))] + [(k, f"line 7\nown {k}") for k in range(2, 11)]
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 60
    want = hashlib.sha256("\n".join(x for x in lines if x != "line 7").encode()).hexdigest()
    assert (got[1].n_lines, got[1].n_dropped, got[1].kept_sha256) == (1_000_000, 1, want) and got[2].n_dropped == 1
