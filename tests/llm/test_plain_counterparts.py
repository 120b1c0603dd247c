"""The pipeline and the quality score against plain Python that shares no code with them."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash
from barloom.llm import quality

SF = "/root/testdata/sf0.001"


def plain_features(text: str) -> list[float]:
    raw = text.encode()
    n, words, lines = len(raw), raw.split(), raw.split(b"\n")
    k = len(words)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    upper, lower, digit = count(range(65, 91)), count(range(97, 123)), count(range(48, 58))
    high, newline, space = count(range(128, 256)), raw.count(b"\n"), count(b" \t\r\v\f")
    pipe, bang, noise, sentence, comma = raw.count(b"|"), raw.count(b"!"), count(b"#$%&*@^~"), count(b".?"), count(b",;:")
    letters = upper + lower + high
    other = n - upper - lower - digit - high - newline - space - pipe - bang - noise - sentence - comma
    mean = sum(map(len, words)) / k if k else 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(raw).values())
    return [
        math.log(n + 1), math.log(k + 1), upper / max(letters, 1), digit / max(n, 1), other / max(n, 1), pipe / max(k, 1), bang / max(k, 1), noise / max(k, 1), sentence / max(k, 1), comma / max(k, 1), high / max(n, 1), newline / max(k, 1),
        len(set(words)) / max(k, 1), sum(a == b for a, b in zip(words, words[1:])) / max(k - 1, 1), mean, math.sqrt(sum((len(w) - mean) ** 2 for w in words) / k) if k else 0.0,
        entropy, len(set(lines)) / len(lines), math.log(n / len(lines) + 1), (letters + digit) / max(n - space - newline, 1),
    ]


def test_features_and_scores_by_hand(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels)
    scored, name = quality.with_score(documents, model)
    for r in scored.collect():
        x = plain_features(r.text or "")
        assert x == pytest.approx(quality.features((r.text or "").encode()), rel=1e-9, abs=1e-12)
        bins = [bisect.bisect_right(cuts.tolist(), v) for cuts, v in zip(model.cuts, quality.features((r.text or "").encode()))]
        raw = model.start + sum(t[b] for t, b in zip(model.tables, bins)) + sum(g[bins[i]][bins[j]] for (i, j), g in zip(model.pairs, model.grids))
        assert r[name] == pytest.approx(1 / (1 + math.exp(-raw)), rel=1e-9)


def plain_print(text: str) -> int:
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_the_stages_behind_the_classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, docs, SF).collect()
    assert 0 < len(good) < docs.count()
    # one document of each group of near copies
    prints = {r.doc_id: plain_print(r.text or "") for r in good}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    single = {i for i in prints if top(i) == i}
    texts = {r.doc_id: r.text for r in good}
    # without passages of a benchmark item
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = plain_words(r.text)
        windows |= {tuple(words[k : k + 10]) for k in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}
    hit = lambda words: any(tuple(words[k : k + n]) in windows for n in sizes for k in range(len(words) - n + 1))
    clean = {i for i in single if not hit(plain_words(texts[i]))}
    assert len(clean) < len(single) < len(good)
    # every document once at least and twice at most, sources raised to the weights of one exponent
    size = {i: max(1, math.ceil(len((texts[i] or "").encode()) / 4)) for i in clean}
    source = {r.doc_id: r.source for r in good}
    tokens = Counter()
    for i in clean:
        tokens[source[i]] += size[i]
    total, least, most = sum(tokens.values()), min(tokens.values()), max(tokens.values())
    exponent = max(0.0, 1 - math.log(2) / math.log(most / least)) if most > least else 0.0
    raised = {s: (n / total) ** exponent for s, n in tokens.items()}
    whole = max(tokens[s] / raised[s] for s in tokens)
    budget = {s: raised[s] * whole for s in tokens}
    out = corpus_pipeline.run(spark, SF).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == clean and set(copies.values()) <= {1, 2}
    taken, largest = Counter(), defaultdict(int)
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
        largest[source[i]] = max(largest[source[i]], size[i])
    for s in tokens:
        assert budget[s] - largest[s] - 1 <= taken[s] <= budget[s] + 1
    # each row in one of 24 shards, of nearly equal bytes
    loads = Counter()
    for r in out:
        loads[r.shard] += len((r.text or "").encode()) + 8
    rows = max(len((r.text or "").encode()) + 8 for r in out)
    assert set(loads) <= set(range(24)) and max(loads.values()) <= sum(loads.values()) / 24 + 2 * rows
