import hashlib
import math
import random
import re
import time
from collections import Counter

from barloom.llm import secret_scan
from barloom.llm.shared import offsets
from pyspark.sql import functions as F
from tests.llm.conftest import PROSE, clashing

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(rows):
    out = []
    for i, t in rows:
        t = t or ""
        found = [
            [m for m in ASSIGN.finditer(t) if len(m[2]) >= 8],
            [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
            [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32],
        ]
        spans = sorted((m.start(), k, m.end()) for k, ms in enumerate(found) for m in ms)
        digest = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in spans)
        out.append((i, *map(len, found), hashlib.sha256(digest.encode()).hexdigest()))
    return sorted(out, key=str)


def test_base_spans_against_brute_force(docs):
    rng = random.Random(6)
    bits = ["token", "TOKEN", "Api_key", "apikey", "secret", "passwd", "=", ":", " ", "  ", '"', "'", "abc", "hunter2-long.value", "k3Y/+_=x", "AKIA", "ABCDEFGH1234", "AKIAAKIA", "0a1b2c3d", "ffffffffffffffff", "é", "🙂", "\n", "日本"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for k in range(400)]
    rows += [(500, None), (501, ""), (502, 'token=token" : abcdefgh'), (503, "secret" + "=" * 9), (504, "a" * 100_000), (505, ("x token=abcdefgh12 " * 300)), (3, rows[3][1]), (None, rows[4][1])]
    out = secret_scan.report(clashing(docs(rows)))
    assert sorted((tuple(r)[:5] for r in out.collect()), key=str) == brute(rows)


SYMBOLS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz", "base36": "0123456789abcdefghijklmnopqrstuvwxyz"}
SYMBOLS |= {"upper": SYMBOLS["base32"][:26], "letters": SYMBOLS["lower"] + SYMBOLS["base32"][:26], "base62": SYMBOLS["base36"] + SYMBOLS["base32"][:26], "base64": SYMBOLS["base36"] + SYMBOLS["base32"][:26] + "+/"}
WORDS = (PROSE + " with many other ordinary words that people write in letters about weather markets music cooking history gardens travel and friends Number 7 of 1985").split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_planted_runs_of_every_encoding_and_length(docs):
    """Nine of ten planted runs are found, and hardly anything else is claimed."""
    rng = random.Random(5)
    planted, plain = [], []
    for k in range(560):
        kind, n = list(SYMBOLS)[k % 8], (20, 24, 30, 31, 40, 64, 128)[k // 8 % 7]
        n = min(n, 31) if kind == "hex" else n  # longer ones are base spans
        planted.append((k, f"{prose(rng, 30)} " + "".join(rng.choice(SYMBOLS[kind]) for _ in range(n)) + f" {prose(rng, 30)}"))
    for k in range(1000, 1400):
        joined = rng.choice(["/", "-", "_", ""]).join(w.capitalize() if k % 3 == 0 else w for w in prose(rng, 8).split())
        plain.append((k, f"{prose(rng, 60)} {joined} {prose(rng, 60)} " + ("a" * 25 + "1" * 25, "ab12" * 9, "0123456789abcdef" * 1, "1234567890" * 4)[k % 4]))
    rows = {r.doc_id: r for r in secret_scan.report(docs(planted + plain)).collect()}
    by_kind = {}
    for k, t in planted:
        start = max((m for m in re.finditer("[A-Za-z0-9+/]{20,}", t)), key=lambda m: len(m[0]))
        by_kind.setdefault((k % 8, k // 8 % 7), []).append(f"random:{start.start()}:{start.end()}" in rows[k].spans.split(","))
    assert min(sum(v) / len(v) for v in by_kind.values()) >= 0.9, by_kind
    assert sum(rows[k].n_random for k, _ in plain) <= 0.05 * 560


def plain_p(token):
    """The least of the battery's three p-values times three, by the textbook."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    symbols = next(a for p, a in secret_scan.ENCODINGS if re.search(p, body))
    body = body.lower() if len(symbols) == 16 else body
    n, k = len(body), len(symbols)
    chi = sum(body.count(c) ** 2 for c in symbols) * k / n - n
    z = ((max(chi, 0) / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / (2 / (9 * (k - 1))) ** 0.5
    v = [symbols.index(c) + 1 for c in body]
    high = sum(x > (k + 1) / 2 for x in v)
    if high in (0, n):
        return 0.0
    runs = 1 + sum((a > (k + 1) / 2) != (b > (k + 1) / 2) for a, b in zip(v, v[1:]))
    expected = 2 * high * (n - high) / n + 1
    y = abs(runs - expected) / max((expected - 1) * (expected - 2) / (n - 1), 1e-9) ** 0.5
    mean = sum(v) / n
    around = sum((x - mean) ** 2 for x in v)
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / around
    w = abs(serial + 1 / n) * n**0.5
    upper = lambda x: math.erfc(x / 2**0.5) / 2
    return min(1.0, 3 * min(upper(z), 2 * upper(y), 2 * upper(w)))


def plain_q(token, text):
    """Cauchy's mean of the three p-values as ordinary text."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    symbols = next(a for p, a in secret_scan.ENCODINGS if re.search(p, body))
    body = body.lower() if len(symbols) == 16 else body
    plain = token.rstrip("=").replace("-", "").replace("_", "").replace("+", "").replace("/", "")
    normal = lambda z: math.erfc(-z / 2**0.5) / 2
    n, (two, three) = len(body), text.same[symbols]
    mean, var = n * (n - 1) * two, 2 * n * (n - 1) * (two - two**2 + 2 * (n - 2) * max(three - two**2, 0))
    g = var / (9 * mean**2)
    even = normal((((sum(body.count(c) ** 2 for c in symbols) - n + 1) / mean) ** (1 / 3) - 1 + g) / g**0.5)
    kind = lambda c: c.isdigit() + 2 * c.isupper()
    m, s = max(len(plain) - 1, 1), text.turns
    w = min(max(sum(kind(a) != kind(b) for a, b in zip(plain, plain[1:])), 1), m)
    a, b, ratio = 1 / (9 * (m - w + 1)), 1 / (9 * w), w * (1 - s) / ((m - w + 1) * s)
    turned = 0.5 if len({kind(c) for c in plain}) == 1 else 1 - normal(((1 - b) * ratio ** (1 / 3) - 1 + a) / (b * ratio ** (2 / 3) + a) ** 0.5)
    pairs = [text.follows[(ord(x) - 97) * 26 + ord(y) - 97] for x, y in zip(body.lower(), body.lower()[1:]) if x.isalpha() and y.isalpha()]
    odd = normal((sum(pairs) - len(pairs) * text.mean) / (len(pairs) * text.variance) ** 0.5) if pairs else 0.5
    t = sum(1 / math.tan(min(max(p, 1e-15), 0.99) * math.pi) for p in (even, turned, odd)) / 3
    return 1 / (t * math.pi) if t > 1e3 else 0.5 - math.atan(t) / math.pi


def test_p_values_and_step_up_against_plain_python(spark, docs):
    rng = random.Random(12)
    token = lambda: "".join(rng.choice(SYMBOLS[rng.choice(list(SYMBOLS))]) for _ in range(rng.randrange(20, 90)))
    uniform = ["".join(rng.choice(SYMBOLS[k]) for _ in range(rng.choice((20, 25, 33, 50, 70)))) for k in SYMBOLS for _ in range(25)]
    tokens = uniform + [token() for _ in range(60)] + ["".join(prose(rng, 7).split()) for _ in range(150)] + ["ThisIsSomeName" * 2 + str(k) for k in range(20)]
    rows = [(k, f"{prose(rng, 40)} {t} {prose(rng, 40)}") for k, t in enumerate(tokens)]
    frame = docs(rows)
    text = secret_scan.ordinary(frame)
    n = Counter()
    for _, t in rows:
        for w in re.findall("[A-Za-z0-9]+", t):
            if len(w) <= 19:
                n.update([*w, *(a + b for a, b in zip(w.lower(), w.lower()[1:])), "^" + w[0].lower()])
                n["turn"] += sum((a.isdigit() + 2 * a.isupper()) != (b.isdigit() + 2 * b.isupper()) for a, b in zip(w, w[1:]))
    assert text == secret_scan._ordinary(n)
    found = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.explode(secret_scan.tested(secret_scan.spans(F.col("t"), secret_scan.TOKEN, "random", 20), text)).alias("m")).select("t", "m.p", "m.q", "m.match").collect()
    for r in found:
        assert r.match == r.t
        for got, want in ((r.p, plain_p(r.t)), (r.q, plain_q(r.t, text))):
            assert abs(got - want) <= 1e-5 * want + 1e-6, (r.t, got, want)
    # the step-up, over whole runs and pieces clear of base spans
    family = []
    for k, t in rows:
        base = [m.span() for p in (ASSIGN, re.compile("[0-9a-f]{32,}")) for m in p.finditer(t)]
        cands = {m.span() for p in (secret_scan.TOKEN, secret_scan.PIECE) for m in re.finditer(p, t)}
        for a, z in cands:
            if not any(x < z and a < y for x, y in base):
                q = plain_q(t[a:z], text) if plain_p(t[a:z]) >= secret_scan.ALPHA else 1.0
                family.append((k, a, z, min(400, math.floor(-math.log10(q) * 20 + 1e-9)), sum(z - a >= c for c in secret_scan.CLASSES)))
    claimed = []
    for c in range(6):
        steps = sorted((f[3] for f in family if f[4] == c), reverse=True)
        limit = min((s for i, s in enumerate(steps, 1) if 10 ** (-s / 20) <= 0.05 * sum(x >= s for x in steps) / len(steps)), default=401)
        claimed += [f for f in family if f[4] == c and f[3] >= max(limit, 1)]
    over = lambda f, g: f[0] == g[0] and f[1] < g[2] and g[1] < f[2] and (g[3], g[2] - g[1]) > (f[3], f[2] - f[1])
    want = sorted((f[0], f"random:{f[1]}:{f[2]}") for f in claimed if not any(over(f, g) for g in claimed))
    got = sorted((r.doc_id, s) for r in secret_scan.report(frame).collect() for s in r.spans.split(",") if s.startswith("random"))
    assert len(set(got) ^ set(want)) <= 2 and len(want) > 150  # a step may differ at a grid line


def test_p_values_are_even_under_randomness(spark):
    rng = random.Random(12)
    rows = [("".join(rng.choice("0123456789abcdef") for _ in range(64)),) for _ in range(600)]
    text = secret_scan._ordinary({})
    found = spark.createDataFrame(rows, "t string").select(F.explode(secret_scan.tested(secret_scan.spans(F.col("t"), secret_scan.TOKEN, "random", 20), text)).alias("m")).select("m.p").collect()
    ps = [r.p for r in found]
    assert len(ps) == 600 and 0.01 < sum(p < 0.05 for p in ps) / 600 < 0.09


def test_running_totals_and_many_matches(spark, docs):
    sizes = [random.Random(n).choices(range(9), k=n) for n in (0, 1, 2, 127, 128, 129, 1000)]
    out = spark.createDataFrame([(s,) for s in sizes], "s array<int>").select("s", offsets(F.col("s")).alias("o")).collect()
    assert all(list(r.o) == [sum(r.s[:i]) for i in range(len(r.s))] for r in out) and len(out) == 7
    many = docs([(1, "token=abcdefgh1 " * 60_000)])
    assert secret_scan.report(many).first().n_assign == 60_000


def test_odd_rows(odd, none):
    assert secret_scan.report(odd).count() == odd.count() and secret_scan.report(none).count() == 0
    assert {r.spans for r in secret_scan.report(odd).collect()} == {""}
    assert PROSE


def test_many_runs_in_one_text(spark):
    """16,000 hex runs and as many others in one text: each is found once, in a time that grows with their number."""
    r = random.Random(1)
    run = lambda symbols, n: "".join(r.choice(symbols) for _ in range(n))
    mixed = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = " ".join(f"{run('0123456789abcdef', 36)} word {run(mixed, 24)}" for _ in range(16_000))
    began = time.time()
    got = secret_scan.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert time.time() - began < 60
    assert got.n_hex == 16_000 and got.n_random >= 15_500


def test_a_run_and_its_pieces(spark):
    """Of nested runs the plain rule, run against run, keeps the same as the sorted sweep."""

    def better(k, m):
        return k[0] < m[1] and m[0] < k[1] and (k[2] > m[2] or (k[2] == m[2] and k[1] - k[0] > m[1] - m[0]))

    cases = [
        [(0, 50, 5), (0, 20, 5), (21, 50, 4)], [(0, 50, 5), (0, 20, 6), (21, 50, 5)], [(0, 50, 5), (0, 20, 4), (21, 50, 7)], [(0, 20, 3), (21, 50, 3)], [(10, 40, 2), (60, 99, 5), (60, 80, 9), (81, 99, 9), (120, 150, 1), (121, 150, 1)], [],
        [(0, 90, 5), (0, 20, 5), (21, 50, 5), (51, 90, 6), (100, 130, 5), (200, 230, 5), (200, 220, 8)],
    ]
    rows = [(n, [(a, b, 3, "random", step, 0) for a, b, step in reversed(case)]) for n, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, runs array<struct<start:int,end:int,rank:int,kind:string,step:int,cls:int>>")
    got = {r.n: [(m.start, m.end) for m in r.best] for r in df.select("n", secret_scan._best("runs").alias("best")).collect()}
    assert got == {n: sorted((m[0], m[1]) for m in case if not any(better(k, m) for k in case)) for n, case in enumerate(cases)}
