import math
from collections import Counter, defaultdict

import pytest
from barloom.llm import mixing
from tests.llm.conftest import clashing


def corpus(docs, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((k, "x" * (40 + k * 37 % 400), source))
            k += 1
    return docs(rows)


def test_budgets_and_epochs(docs):
    frame = corpus(docs, {"big": 900, "mid": 200, "small": 60, None: 25})
    rows = mixing.report(clashing(frame)).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.source].append(r)
    assert len(rows) == 1185 and all(r.n_tokens == math.ceil((40 + r.doc_id * 37 % 400) / 4) for r in rows)
    total = {s: sum(r.n_tokens for r in v) for s, v in per.items()}
    got = {s: sum(r.n_tokens * r.copies for r in v) for s, v in per.items()}
    budget = {s: v[0].budget for s, v in per.items()}
    largest = max(r.n_tokens for r in rows)
    for s in per:
        assert budget[s] - largest < got[s] <= budget[s]  # within a document of the budget, never over it
        assert {r.copies for r in per[s]} <= {math.floor(budget[s] / total[s]), math.floor(budget[s] / total[s]) + 1}
    assert all(r.copies == 1 for r in per["big"]) and max(budget[s] / total[s] for s in per) == pytest.approx(2, rel=1e-3)
    assert sum(v[0].weight for v in per.values()) == pytest.approx(1, abs=1e-6)
    order = sorted(total, key=total.get)
    assert [per[s][0].weight for s in order] == sorted(v[0].weight for v in per.values())


def test_least_entropy_is_met_by_the_largest_exponent(docs):
    frame = corpus(docs, {"a": 400, "b": 60, "c": 20})
    goal = {r.key: r for r in mixing.targets(frame, least_entropy=0.9).collect()}
    entropy = -sum(r.weight * math.log(r.weight) for r in goal.values())
    assert entropy == pytest.approx(0.9 * math.log(3), abs=1e-6) and 0 < goal["sa"].exponent < 1
    assert {r.exponent for r in mixing.targets(frame, least_entropy=0.1).collect()} == {1.0}


def test_a_given_budget_can_drop(docs):
    frame = corpus(docs, {"a": 300, "b": 300})
    total = sum(r.n_tokens for r in mixing.report(frame).collect())
    kept = [r for r in mixing.report(frame, budget=total // 2).collect() if r.copies]
    assert 0.95 * total / 2 < sum(r.n_tokens for r in kept) <= total / 2


def test_mix_keeps_columns_and_does_not_depend_on_the_dealing(docs, odd, none):
    frame = clashing(corpus(docs, {"a": 200, "b": 40}))
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    want = Counter({r.doc_id: r.copies for r in mixing.report(frame).collect()})
    assert Counter(r.doc_id for r in out.collect()) == want == Counter(r.doc_id for r in mixing.mix(frame.repartition(7)).collect())
    assert mixing.report(odd).count() == odd.count() and mixing.mix(odd).count() >= odd.count()
    assert mixing.report(none).count() == 0 and mixing.mix(none).count() == 0


def test_a_hot_source_is_ordered_in_blocks(docs):
    frame = corpus(docs, {"hot": 2000, "cold": 100})
    copies = {r.doc_id: r.copies for r in mixing.report(frame, max_epochs=1.5).collect()}
    cold = [copies[k] for k in range(2000, 2100)]
    assert 40 < sum(c == 2 for c in cold) < 60 and set(cold) == {1, 2}


@pytest.mark.parametrize("total", [7_500_000_000, 250_000_000_000, 2_500_000_000_000])
def test_tiny_sources_beside_a_huge_one_keep_their_epochs(docs, monkeypatch, total):
    monkeypatch.setattr(mixing, "tokens", lambda text: text.cast("long"))  # texts say their own size
    sizes = [total, total // 100, 1, 2, 3, 10, 50, 200]
    frame = docs([(k, str(n), f"t{n}") for k, n in enumerate(sizes)])
    goal = {r.tokens: r.budget for r in mixing.targets(frame).collect()}
    assert sorted(goal) == sorted(sizes) and all(n <= b <= 2 * n for n, b in goal.items())  # nothing dropped, and no more epochs than asked
    assert goal[total] == total and goal[1] == 2
    assert {r.doc_id for r in mixing.mix(frame).collect()} == set(range(len(sizes)))
    given = mixing.targets(frame, budget=total // 2).collect()
    assert sum(r.budget for r in given) == pytest.approx(total // 2, abs=len(sizes))


@pytest.mark.parametrize("options", [{}, {"least_entropy": 0.97}, {"max_epochs": 5.0}])
def test_many_sources_without_gathering_them(spark, options):
    """Forty thousand sources: the exponent and the weights of plain Python, from sums alone."""
    sizes = [1 + (k * 7919) % 1000 + 50_000 * (k % 5000 == 0) for k in range(40_000)]
    stats = spark.createDataFrame([(f"s{k}", 1, n) for k, n in enumerate(sizes)], "key string, docs long, tokens long")
    got = {r.key: r for r in mixing.budgets(stats, **options).collect()}
    total = sum(sizes)
    shares = [n / total for n in sizes]

    def weights(x):
        raised = [s**x for s in shares]
        whole = math.fsum(raised)
        return [r / whole for r in raised]

    entropy = lambda x: -math.fsum(w * math.log(w) for w in weights(x))
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        if "least_entropy" in options:
            lo, hi = (mid, hi) if entropy(mid) >= options["least_entropy"] * math.log(len(sizes)) else (lo, mid)
        else:
            lo, hi = (lo, mid) if (max(shares) / min(shares)) ** (1 - mid) <= options.get("max_epochs", mixing.MAX_EPOCHS) else (mid, hi)
    assert got["s0"].exponent == pytest.approx(lo, abs=1e-9)
    want = weights(got["s0"].exponent)
    assert max(abs(got[f"s{k}"].weight - w) for k, w in enumerate(want)) <= 1e-9
    assert all(r.budget >= r.tokens for r in got.values())
