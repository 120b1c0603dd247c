"""Secret scans: known forms of secrets, and runs of characters that pass for random.

The base finds assignments, access keys and hex runs by pattern. The method adds ``random`` spans: runs
of 20 token characters or more, and the pieces of such runs between separators. The encoding of each is
inferred, and a battery of three tests - chi-squared uniformity over the encoding's alphabet, runs, and
serial correlation - is read both ways:

* against even and independent draws from the alphabet: a candidate that any test rejects (``ALPHA``)
  is no random run;
* against ordinary text, as measured over all documents: how often symbols coincide, how often the class
  of characters changes, how likely each letter follows the one before it. Its three p-values are
  combined by their Cauchy mean, which holds under any dependence.

What is claimed, then, is "not ordinary text", and the false discoveries of that claim are controlled:
within each class of length, Benjamini and Hochberg's step-up over all candidates of the corpus that no
base span covers decides. A run too short or of an alphabet too plain to be told from text (digits alone)
has a large p-value and isn't claimed.

All is done by DataFrame functions: ``split`` by a pattern gives the pieces around its matches and their
lengths the offsets. Texts are read twice, once for the words' counts and once for the spans; spans with
their p-values, without the texts of the secrets, are stored in between.

Defined cases: a null text is an empty one, without spans; offsets count code points and ends are
exclusive; rows that repeat have the same spans; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import durable, let, offsets

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of at least so many characters is one match from its first on, so the least length can stand in the pattern;
#: not so for ASSIGN, where a match that is too short still hides those that overlap it.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: token characters, with padding at the end alone; and the pieces of such runs
TOKEN, PIECE = r"[A-Za-z0-9+/_-]{20,}={0,2}", r"[A-Za-z0-9]{20,}"
WORD = r"[A-Za-z0-9]+"
LONGEST_WORD = 19  #: longer ones are candidates themselves and don't count as ordinary text
KINDS = ("assign", "access", "hex", "random")  #: in the order that ties are listed
LEVEL = 0.05  #: share of false discoveries among the runs claimed
ALPHA = 0.001  #: share of truly random runs that the battery may reject
GRID = 400  #: p-values are counted on a grid of this many steps of their logarithm
DECADES = 20.0  #: that reaches down to 10 to the power of minus this
CLASSES = (24, 32, 40, 64, 128)  #: lengths at which the classes of the step-up begin

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: encodings in the order they are tried: pattern, alphabet
ENCODINGS = (
    (r"^[0-9]+$", DIGITS),
    (r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + LOWER[:6]),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+$", DIGITS[2:8] + UPPER),
    (r"^[A-Z0-9]+$", DIGITS + UPPER),
    (r"^[a-z0-9]+$", DIGITS + LOWER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    (r"", "+/" + DIGITS + UPPER + LOWER),
)
TURN = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"  #: places where the class of characters changes
_SPAN = "struct<start:int,end:int,rank:int,kind:string,match:string,judged:int>"


def spans(text: Column, pattern: str, kind: str, least: int, group: int = 0) -> Column:
    """The leftmost non-overlapping matches whose ``group`` has ``least`` characters or more, as structs of
    (start, end, rank, kind, match)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)

    def placed(found: Column) -> Column:
        pieces = F.transform(F.arrays_zip(F.slice(found["gaps"], 1, F.size(found["whole"])).alias("gap"), found["whole"].alias("whole"), found["judged"].alias("judged")), lambda m: F.struct(F.char_length(m["gap"]).alias("gap"), F.char_length(m["whole"]).alias("n"), m["whole"].alias("match"), F.char_length(m["judged"]).alias("judged")))
        return let(pieces, lambda ms: F.zip_with(ms, offsets(F.transform(ms, lambda m: m["gap"] + m["n"])), one))

    def one(m: Column, before: Column) -> Column:
        start = before + m["gap"]
        return F.struct(start.alias("start"), (start + m["n"]).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["match"].alias("match"), m["judged"].alias("judged"))

    return F.filter(let(F.struct(whole.alias("whole"), judged.alias("judged"), gaps.alias("gaps")), placed), lambda m: m["judged"] >= least)


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def base_spans(text: Column, has_run: Column) -> dict[str, Column]:
    """The spans of each base kind; the patterns are only walked in texts that have a match. ``has_run`` tells
    whether the text has a TOKEN at all, as every hex run is one."""
    return {
        "assign": F.when(text.rlike(ASSIGN), spans(text, ASSIGN, "assign", 8, 1)).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, "access", 16)).otherwise(_none()),
        "hex": F.when(has_run, spans(text, HEX, "hex", 32)).otherwise(_none()),
    }


def _with(found: Column, **more) -> Column:
    """An array of structs with more fields, each made from the struct. Made step by step, an
    expression never repeats the one below it."""
    return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["rank"], m["kind"], m["match"], m["judged"], *(f(m).alias(k) for k, f in more.items())))


def _tail(t: Column, x: Column) -> Column:
    """Chance that a standard normal value is over x times the root of 2, x being positive and t 1 / (1 + x / 2); a
    rational fit of erfc, good to 1e-7 of itself."""
    fit = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        fit = fit * t + c
    return t * F.exp(-x * x + fit) / 2


@dataclass(frozen=True)
class Ordinary:
    """What ordinary text is like: by encoding the chances that two or three of its symbols are the same one,
    the share of places at which the class of characters changes, and for each pair of letters the logarithm
    of the chance that the second follows the first, with its mean and variance."""

    same: dict[str, tuple[float, float]]
    turns: float
    follows: list[float]
    mean: float
    variance: float


def ordinary(documents: DataFrame) -> Ordinary:
    """Measured over the words of all documents. Words are added up first, so that their insides are looked at
    once each; as many counts as there are symbols and pairs of letters come to the driver."""
    word = F.explode(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))).alias("word")
    words = documents.select(word).where(F.char_length("word") <= LONGEST_WORD).groupBy("word").agg(F.count("*").alias("n"))
    symbols = F.filter(F.split("word", ""), lambda c: c != "")
    small = F.filter(F.split(F.lower("word"), ""), lambda c: c != "")
    pairs = F.zip_with(F.slice("small", 1, F.size("small") - 1), F.slice("small", 2, F.size("small") - 1), lambda a, b: F.concat(a, b))
    marks = F.concat(F.col("symbols"), pairs, F.array(F.concat(F.lit("^"), F.get("small", F.lit(0)))), F.array_repeat(F.lit("turn"), F.regexp_count("word", F.lit(TURN))))
    counted = words.select("n", symbols.alias("symbols"), small.alias("small"), "word").select("n", F.explode(marks).alias("mark")).groupBy("mark").agg(F.sum("n").alias("n"))
    n = {r.mark: r.n for r in counted.collect()}
    return _ordinary(n)


def _ordinary(n: dict[str, int]) -> Ordinary:
    get = lambda k: n.get(k, 0) + 0.5
    folded = {c: get(c) + get(c.upper()) for c in LOWER}
    same = {}
    for _, symbols in ENCODINGS:
        cased = any(c in symbols for c in UPPER) and any(c in symbols for c in LOWER)
        weights = [get(c) if cased or c not in UPPER + LOWER else folded[c.lower()] for c in symbols]
        whole = sum(weights)
        same[symbols] = (sum((w / whole) ** 2 for w in weights), sum((w / whole) ** 3 for w in weights))
    begins = {c: get("^" + c) for c in LOWER}
    letters, words = sum(folded.values()), sum(begins.values()) + sum(get("^" + c) for c in DIGITS)
    characters = letters + sum(get(c) for c in DIGITS)
    # ordinary tokens may be words put together; of the joints every second one changes the class there and back
    turns = min(0.9, (n.get("turn", 0) + words) / characters)
    joint = min(0.5, sum(begins.values()) / letters)
    follows, mean, square = [], 0.0, 0.0
    for a in LOWER:
        after = {b: get(a + b) for b in LOWER}
        for b in LOWER:
            chance = (1 - joint) * after[b] / sum(after.values()) + joint * begins[b] / sum(begins.values())
            follows.append(log(chance))
            mean += folded[a] / letters * chance * log(chance)
            square += folded[a] / letters * chance * log(chance) ** 2
    return Ordinary(same, turns, follows, mean, max(square - mean**2, 1e-3))


def _normal(z: Column) -> Column:
    """Chance that a standard normal value is under z; an odd logistic fit, good to a few percent of itself in the tails."""
    a = let(F.abs(z) / 2**0.5, lambda x: let(F.struct(x.alias("x"), (1 / (1 + x / 2)).alias("t")), lambda s: _tail(s["t"], s["x"])))
    return F.when(z < 0, a).otherwise(1 - a)


def unlike_text(m: Column, text: Ordinary) -> Column:
    """The p-value of a candidate (n, squares, symbols, turns, body) as ordinary text: small where its symbols
    coincide too rarely, their classes change too often, and letters follow each other too oddly."""
    n = m["n"]
    # coincident pairs of symbols, in order: as many as a gamma variable of their mean and variance
    both = lambda k: F.element_at(F.create_map(*[x for s, p in text.same.items() for x in (F.lit(s), F.lit(p[k]))]), m["symbols"])

    def coincide(q: Column) -> Column:
        mean = n * (n - 1) * q["two"]
        variance = 2 * n * (n - 1) * (q["two"] - q["two"] * q["two"] + 2 * (n - 2) * F.greatest(q["three"] - q["two"] * q["two"], F.lit(0.0)))
        return let(F.struct(mean.alias("mean"), (variance / (9 * mean * mean)).alias("part")), lambda g: _normal((F.pow((m["squares"] - n + 1) / g["mean"], F.lit(1 / 3)) - 1 + g["part"]) / F.sqrt(g["part"])))

    even = let(F.struct(both(0).alias("two"), both(1).alias("three")), coincide)
    # changes of class: a binomial variable, by Camp and Paulson's root
    places = F.greatest(F.char_length(m["plain"]).cast("double") - 1, F.lit(1.0))
    s = text.turns

    def changed(w: Column) -> Column:
        a, b = 1 / (9 * (places - w + 1)), 1 / (9 * w)
        ratio = w * (1 - s) / ((places - w + 1) * s)
        return 1 - _normal(((1 - b) * F.pow(ratio, F.lit(1 / 3)) - 1 + a) / F.sqrt(b * F.pow(ratio, F.lit(2 / 3)) + a))

    one_class = m["plain"].rlike("^(?:[a-z]+|[A-Z]+|[0-9]+)$")
    turned = F.when(one_class, F.lit(0.5)).otherwise(let(F.greatest(F.least(m["turns"].cast("double"), places), F.lit(1.0)), changed))
    # letters after letters
    at = F.transform(F.split(F.lower(m["body"]), ""), lambda c: F.when(c != "", F.instr(F.lit(LOWER), c)).otherwise(0))
    table = F.lit(text.follows)
    logs = let(at, lambda xs: F.filter(F.zip_with(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: F.when((a > 0) & (b > 0), F.get(table, (a - 1) * 26 + b - 1))), lambda v: v.isNotNull()))
    odd = let(logs, lambda v: F.when(F.size(v) == 0, F.lit(0.5)).otherwise(_normal((F.aggregate(v, F.lit(0.0), lambda t, x: t + x) - F.size(v) * text.mean) / F.sqrt(F.size(v) * text.variance))))
    held = lambda p: F.least(F.greatest(p, F.lit(1e-15)), F.lit(0.99))
    cauchy = lambda p: 1 / F.tan(held(p) * 3.141592653589793)
    return let((cauchy(even) + cauchy(turned) + cauchy(odd)) / 3, lambda t: F.when(t > 1e3, 1 / (t * 3.141592653589793)).otherwise(0.5 - F.atan(t) / 3.141592653589793))


def tested(found: Column, text: Ordinary) -> Column:
    """``found`` with ``p``, the p-value of each match under even and independent draws from the alphabet of
    its encoding, and ``q``, its p-value as ordinary text."""
    out = _with(found, body=lambda m: F.rtrim(F.translate(m["match"], "-_", "+/"), F.lit("=")))

    def alphabet(m: Column) -> Column:
        name = F.lit(ENCODINGS[-1][1])
        for pattern, symbols in reversed(ENCODINGS[:-1]):
            name = F.when(m["body"].rlike(pattern), F.lit(symbols)).otherwise(name)
        return name

    out = _with(out, body=lambda m: m["body"], symbols=alphabet, plain=lambda m: F.translate(m["body"], "+/", ""))
    hex_ = ENCODINGS[1][1]
    out = _with(out, body=lambda m: F.when(m["symbols"] == hex_, F.lower(m["body"])).otherwise(m["body"]), symbols=lambda m: m["symbols"], plain=lambda m: m["plain"])
    out = _with(
        out,
        n=lambda m: F.char_length(m["body"]).cast("double"),
        k=lambda m: F.char_length(m["symbols"]).cast("double"),
        values=lambda m: F.filter(F.transform(F.split(m["body"], ""), lambda c: F.instr(m["symbols"], c).cast("double")), lambda v: v > 0),
        squares=lambda m: F.aggregate(F.filter(F.split(m["symbols"], ""), lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.pow(F.char_length(m["body"]) - F.char_length(F.replace(m["body"], c, F.lit(""))), F.lit(2.0))),
        turns=lambda m: F.regexp_count(m["plain"], F.lit(TURN)),
        **{x: (lambda m, x=x: m[x]) for x in ("symbols", "plain", "body")},
    )
    keep = {x: (lambda m, x=x: m[x]) for x in ("n", "k", "values")}
    out = _with(
        out, **keep, q=lambda m: unlike_text(m, text),
        chi=lambda m: m["squares"] * m["k"] / m["n"] - m["n"],
        high=lambda m: F.aggregate(m["values"], F.lit(0.0), lambda s, v: s + (v > (m["k"] + 1) / 2).cast("double")),
        mean=lambda m: F.aggregate(m["values"], F.lit(0.0), lambda s, v: s + v) / m["n"],
    )
    pairs = lambda m: F.zip_with(F.slice(m["values"], 1, F.greatest(F.size(m["values"]) - 1, F.lit(0))), F.slice(m["values"], 2, F.greatest(F.size(m["values"]) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    keep |= {x: (lambda m, x=x: m[x]) for x in ("chi", "high", "q")}
    del keep["values"]
    out = _with(
        out, **keep,
        around=lambda m: F.aggregate(m["values"], F.lit(0.0), lambda s, v: s + (v - m["mean"]) * (v - m["mean"])),
        lagged=lambda m: F.aggregate(pairs(m), F.lit(0.0), lambda s, p: s + (p["a"] - m["mean"]) * (p["b"] - m["mean"])),
        turns=lambda m: F.aggregate(pairs(m), F.lit(1.0), lambda s, p: s + ((p["a"] > (m["k"] + 1) / 2) != (p["b"] > (m["k"] + 1) / 2)).cast("double")),
        expected=lambda m: 2 * m["high"] * (m["n"] - m["high"]) / m["n"] + 1,
    )
    # each test as a standard normal value; where one side of the middle or one symbol is all there is, it is far out
    far = F.lit(37.0)
    keep = {"q": lambda m: m["q"]}
    out = _with(
        out, **keep,
        uneven=lambda m: (F.pow(F.greatest(m["chi"], F.lit(0.0)) / (m["k"] - 1), F.lit(1 / 3)) - 1 + 2 / (9 * (m["k"] - 1))) / F.sqrt(2 / (9 * (m["k"] - 1))),
        clustered=lambda m: F.when((m["high"] == 0) | (m["high"] == m["n"]), far).otherwise(F.abs(m["turns"] - m["expected"]) / F.sqrt(F.greatest((m["expected"] - 1) * (m["expected"] - 2) / (m["n"] - 1), F.lit(1e-9)))),
        serial=lambda m: F.when(m["around"] < 1e-9, far).otherwise(F.abs(m["lagged"] / F.greatest(m["around"], F.lit(1e-9)) + 1 / m["n"]) * F.sqrt(m["n"])),
    )
    sides = {"uneven": 1, "clustered": 2, "serial": 2}
    over = lambda z: let(F.abs(z) / 2**0.5, lambda x: let(F.struct(x.alias("x"), (1 / (1 + x / 2)).alias("t")), lambda v: _tail(v["t"], v["x"])))
    out = _with(out, **keep, low=lambda m: m["uneven"] < 0, **{f"p_{z}": (lambda m, z=z: sides[z] * over(m[z])) for z in sides})
    least = lambda m: F.least(F.when(m["low"], 1 - m["p_uneven"]).otherwise(m["p_uneven"]), m["p_clustered"], m["p_serial"])
    return _with(out, **keep, p=lambda m: F.least(F.lit(1.0), 3 * least(m)))


def _below(found: Column, place: Column) -> Column:
    """How many of ``found``, which is in order of start, start before ``place``: a binary search."""
    powers = F.array(*[F.lit(1 << k) for k in range(26, -1, -1)])
    fits = lambda at, k: F.coalesce(F.get(found, at + k - 1)["start"] < place, F.lit(False))
    return F.aggregate(powers, F.lit(0), lambda at, k: F.when(fits(at, k), at + k).otherwise(at))


def _meets(found: Column, m: Column) -> Column:
    """Whether one of ``found``, in order and apart from each other, overlaps ``m``: the last that starts before its end."""
    return F.coalesce(F.get(found, _below(found, m["end"]) - 1)["end"] > m["start"], F.lit(False))


def _step(p: Column) -> Column:
    """The grid step of a p-value; higher steps are smaller values."""
    return F.least(F.lit(GRID), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / DECADES * GRID)).cast("int")


def _class(length: Column) -> Column:
    return sum(((length >= c).cast("int") for c in CLASSES), F.lit(0))


def candidates(documents: DataFrame, text: Ordinary) -> DataFrame:
    """(doc_id, assign, access, hex, runs): the base spans of every document, and its candidates clear of
    them, with the class of their length and the grid step of ``q``, which is 0 (``q`` being 1) where the
    battery rejects: so the family that the step-up judges is every candidate.

    A candidate is a whole run, or a piece of one with separators. The text of none is kept."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).select("*", F.col("body").rlike(TOKEN).alias("has_run"))
    body, has_run = F.col("body"), F.col("has_run")
    base = base_spans(body, has_run)
    same = lambda a, b: F.coalesce((a["start"] == b["start"]) & (a["end"] == b["end"]), F.lit(False))
    both = let(F.array_sort(F.concat(spans(body, TOKEN, "random", 20), spans(body, PIECE, "random", 20))), lambda ms: F.filter(ms, lambda m, i: ~same(m, F.get(ms, i - 1))))
    found = texts.select("doc_id", *(c.alias(k) for k, c in base.items()), F.when(has_run, both).otherwise(_none()).alias("runs"))
    clear = F.filter("runs", lambda m: ~(_meets(F.col("assign"), m) | _meets(F.col("access"), m) | _meets(F.col("hex"), m)))
    bare = lambda ms, **more: F.transform(ms, lambda m: F.struct(m["start"], m["end"], m["rank"], m["kind"], *(f(m).alias(k) for k, f in more.items())))
    runs = bare(tested(clear, text), step=lambda m: F.when(m["p"] >= ALPHA, _step(m["q"])).otherwise(0), cls=lambda m: _class(m["end"] - m["start"]))
    return found.select("doc_id", *(bare(F.col(k)).alias(k) for k in base), F.when(F.size("runs") > 0, runs).otherwise(F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,step:int,cls:int>>")).alias("runs"))


def thresholds(found: DataFrame) -> list[int]:
    """Per class of length, the grid step from which candidates are claimed (GRID + 1: none).

    The step-up over all candidates of the corpus, p-values rounded up to the grid. Shuffled are
    counts per class and step; a number per class comes to the driver."""
    counts = found.where(F.size("runs") > 0).select(F.explode("runs").alias("m")).groupBy("m.cls", "m.step").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("cls").orderBy(F.desc("step")))
    every = F.sum("n").over(Window.partitionBy("cls"))
    passed = counts.select("cls", "step", below.alias("below"), every.alias("every")).where(F.pow(F.lit(10.0), -F.col("step") * DECADES / GRID) <= LEVEL * F.col("below") / F.col("every"))
    least = {r.cls: r.step for r in passed.groupBy("cls").agg(F.min("step").alias("step")).collect()}
    return [least.get(c, GRID + 1) for c in range(len(CLASSES) + 1)]


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of spans (start, end, rank, kind) for every document.

    Of a run and a piece of it that are both claimed, the one less like text stays."""
    found = durable(candidates(documents, ordinary(documents)))
    limits = F.array(*[F.lit(s) for s in thresholds(found)])
    claimed = found.withColumn("runs", F.filter("runs", lambda m: (m["step"] > 0) & (m["step"] >= F.get(limits, m["cls"]))))
    return claimed.select("doc_id", "assign", "access", "hex", F.transform(_best("runs"), lambda m: F.struct(m["start"], m["end"], m["rank"], m["kind"])).alias("random"))


def _best(runs: str) -> Column:
    """Of a run and the pieces of it: the run, unless one of them is less like text, and then those that are.

    Sorted, a run comes right before its pieces, and what contains nothing starts after all before it has ended."""
    order = F.array_sort(F.transform(runs, lambda m: F.struct(m["start"], (-m["end"]).alias("back"), m["end"], m["rank"], m["kind"], m["step"])))

    def chosen(ms: Column, holders: Column) -> Column:
        def stays(m: Column, i: Column) -> Column:
            holder = F.get(holders, _below(holders, m["start"] + 1) - 1)
            held = (holder["end"] > m["start"]) & ~((holder["start"] == m["start"]) & (holder["end"] == m["end"]))
            inner = F.slice(ms, i + 2, F.greatest(_below(ms, m["end"]) - i - 1, F.lit(0)))
            return F.when(F.coalesce(held, F.lit(False)), m["step"] > holder["step"]).otherwise(~F.exists(inner, lambda k: k["step"] > m["step"]))

        return F.filter(ms, stays)

    holds = lambda ms: F.filter(ms, lambda m, i: F.coalesce(F.get(ms, i + 1)["start"] < m["end"], F.lit(False)))
    return let(order, lambda ms: let(holds(ms), lambda holders: chosen(ms, holders)))


def _digest(found: Column) -> Column:
    """kind:start:end of each span, by start and then kind."""
    order = F.array_sort(F.transform(found, lambda m: F.struct(m["start"], m["rank"], m["end"], m["kind"])))
    return F.array_join(F.transform(order, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every document."""
    found = scan(documents.select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.concat(base, F.col("random"))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
