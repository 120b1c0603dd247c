"""Mixing sources to target weights by temperature.

Token shares are raised to an exponent between 0 and 1 and normalised. The exponent is the largest
one that meets the target, found by bisection: a least entropy of the weights (as a share of the
greatest possible), or, the other way round, the smallest one that asks no source to be repeated
more than ``max_epochs`` times. Each source's budget in tokens is then realised from whole
documents: full epochs first, and for the rest blocks of documents in a permuted order, whole
blocks and of the last one as many documents, in its own permuted order, as the budget holds.

A source of n documents has about sqrt(n) blocks of sqrt(n) documents. Only sums per source and block
are ordered, and one block per source is ordered inside, so no source is gathered; what each document
then needs is a row of its source, and its text isn't shuffled.

Defined cases: null sources are a source of their own; a null or empty text has one token; rows that
repeat an id in a source are taken together or not at all; an empty table gives an empty result;
other columns are kept by ``mix`` (with clashing names as they are) and ignored by ``report``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.shared import durable, fresh_name

MAX_EPOCHS = 2.0  #: how often the smallest source may be repeated
BYTES_PER_TOKEN = 4
STEPS = 50  #: of the bisection
GRID = 8  #: exponents that are tried in one pass over the sources
SEED = "mix"
BROADCAST_SOURCES = 100_000  #: sources, of some 200 bytes each, that are broadcast at most


def tokens(text: Column, bytes_per_token: int = BYTES_PER_TOKEN) -> Column:
    """An estimate by size; every document has one token at least."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / bytes_per_token), F.lit(1)).cast("long")


def source_key(source: Column) -> Column:
    """The source as text, null set apart from any name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _smallest(fits: Callable[[float], bool]) -> float:
    """The smallest exponent in [0, 1] that fits, where all larger ones do."""
    lo, hi = 0.0, 1.0
    if fits(lo):
        return lo
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


def _summed(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order."""
    return F.sum(value.cast("decimal(38,24)")).cast("double")


def _entropies(stats: DataFrame, share: Column, exponents: list[float]) -> list[float]:
    """The entropy of the weights for each exponent, from two sums over the sources each."""
    sums = [f(F.pow(share, F.lit(x))) for x in exponents for f in (_summed, lambda r: _summed(r * F.ln(share)))]
    found = stats.agg(*(c.alias(f"s{k}") for k, c in enumerate(sums))).first()
    return [math.log(found[2 * k]) - x * found[2 * k + 1] / found[2 * k] for k, x in enumerate(exponents)]


def _largest(stats: DataFrame, share: Column, least: float) -> float:
    """The largest exponent in [0, 1] whose weights have an entropy of ``least``; each pass over the sources narrows it to one
    part in GRID, which is several steps of the bisection at once."""
    if _entropies(stats, share, [1.0])[0] >= least:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(math.ceil(STEPS / math.log2(GRID))):
        tried = [lo + (hi - lo) * k / GRID for k in range(1, GRID)]
        good = sum(h >= least for h in _entropies(stats, share, tried))  # entropy falls as the exponent grows
        lo, hi = ([lo, *tried][good], [*tried, hi][good])
    return lo


def targets(documents: DataFrame, max_epochs: float | None = MAX_EPOCHS, least_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """A row per source: key, docs, tokens, weight and budget in tokens.

    With ``least_entropy`` (0 to 1, of the entropy of equal weights) the exponent is the largest that
    reaches it, else the smallest that keeps to ``max_epochs``. Without ``budget`` the total is the least
    that drops nothing: the source with most documents for its weight is seen once.
    """
    sized = documents.select(source_key(F.col("source")).alias("key"), tokens(F.col("text")).alias("tokens"))
    return budgets(sized.groupBy("key").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), max_epochs, least_entropy, budget)


def budgets(stats: DataFrame, max_epochs: float | None = MAX_EPOCHS, least_entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """``targets`` from (key, docs, tokens) of each source. Only the weight that is shown is rounded. Of the sources only sums
    and bounds come to the driver, however many there are."""
    stats = durable(stats)
    total, least, most, n = stats.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n:
        return stats.select("key", "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("exponent"), F.col("tokens").alias("budget"))
    share = F.col("tokens") / F.lit(total)
    if least_entropy is not None:
        exponent = _largest(stats, share, least_entropy * math.log(n) - 1e-12)
    else:  # the most epochs of any source, when the budget lets the least repeated one be seen once
        exponent = _smallest(lambda x: (least / total) ** (x - 1) / (most / total) ** (x - 1) <= max_epochs + 1e-12)
    raised = F.pow(share, F.lit(exponent))
    weight = raised / F.lit(stats.agg(_summed(raised)).first()[0])
    whole = float(budget) if budget is not None else stats.agg(F.max(F.col("tokens") / weight)).first()[0]
    # whole tokens; a budget that the doubles leave a hair off a full epoch is that epoch
    asked = F.round(weight * F.lit(whole)).cast("long")
    near = F.round(asked / F.col("tokens")).cast("long") * F.col("tokens")
    asked = F.when(F.abs(asked - near) <= F.col("tokens") * 1e-12, near).otherwise(asked)
    if budget is None:
        asked = F.greatest(asked, F.col("tokens"))
    return stats.select("key", "docs", "tokens", F.round(weight, 9).alias("weight"), F.lit(exponent).alias("exponent"), asked.alias("budget"))


def _order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def _block(doc_key: Column, docs: Column) -> Column:
    """The block of a document: its hash over about sqrt(docs) blocks."""
    return F.pmod(F.conv(F.substring(doc_key, 1, 8), 16, 10).cast("long"), F.ceil(F.sqrt(docs.cast("double"))).cast("long"))


def _doc_key(doc_id: Column) -> Column:
    return _order(F.lit("doc"), F.coalesce(doc_id.cast("string"), F.lit("null")))


def schedule(documents: DataFrame, **options: float | None) -> DataFrame:
    """A row per source, on top of ``targets``: the full epochs, and where the rest of the budget ends -
    blocks whose order is under ``cut_order`` are taken whole, and of the block at it the documents with
    keys up to ``cut_key``. What is taken adds up to the budget at most."""
    goal = durable(targets(documents, **options).withColumn("epochs", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    light = documents.select(source_key(F.col("source")).alias("key"), _doc_key(F.col("doc_id")).alias("doc_key"), tokens(F.col("text")).alias("n"))
    placed = light.join(goal.select("key", "docs", "rest"), "key").where("rest > 0").select("key", "doc_key", "n", _block(F.col("doc_key"), F.col("docs")).alias("block"))
    sums = placed.groupBy("key", "block").agg(F.sum("n").alias("n")).withColumn("order", _order(F.lit("block"), F.col("key"), F.col("block").cast("string")))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("order", "block")))
    split = upto.join(goal.select("key", "rest"), "key").where("upto > rest and upto - n <= rest").select("key", "block", "order", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    split = durable(split)
    inside = placed.join(split, ["key", "block"]).groupBy("key", "block", "order", "left", "doc_key").agg(F.sum("n").alias("n"))
    filled = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "block").orderBy("doc_key"))).where("upto <= left")
    cut = filled.groupBy("key").agg(F.max("doc_key").alias("cut_key"))
    return durable(goal.join(split.select("key", F.col("order").alias("cut_order")), "key", "left").join(cut, "key", "left"))


def _scheduled(documents: DataFrame, **options: float | None) -> tuple[DataFrame, str]:
    """``documents`` with their copies and their source's weight in one more column, and its name. Up to
    BROADCAST_SOURCES sources are broadcast; beyond, documents are shuffled and Spark splits the hot sources."""
    plan = schedule(documents, **options)
    own, name = fresh_name(documents, "mix_key"), fresh_name(documents, "mix")
    id_ = fresh_name(documents, "mix_id")
    left = documents.withColumn(own, source_key(F.col("source"))).withColumn(id_, F.col("doc_id"))
    right = plan.select(F.col("key").alias(f"{own}_"), F.struct("key", "docs", "epochs", "cut_order", "cut_key", "weight", "budget").alias(name))
    if plan.count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    joined = left.join(right, left[own] == right[f"{own}_"])
    doc_key = _doc_key(F.col(id_))
    order = _order(F.lit("block"), F.col(f"{name}.key"), _block(doc_key, F.col(f"{name}.docs")).cast("string"))
    more = F.coalesce((order < F.col(f"{name}.cut_order")) | ((order == F.col(f"{name}.cut_order")) & (doc_key <= F.col(f"{name}.cut_key"))), F.lit(False))
    value = F.struct((F.col(f"{name}.epochs") + more.cast("int")).cast("int").alias("copies"), F.col(f"{name}.weight"), F.col(f"{name}.budget"))
    return joined.withColumn(name, value).drop(own, f"{own}_", id_), name


def mix(documents: DataFrame, **options: float | None) -> DataFrame:
    """``documents``, each as often as its source's weight asks for, with their columns."""
    out, name = _scheduled(documents, **options)
    copy = fresh_name(out, "copy")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(f"{name}.copies")))).select(documents.columns)


def report(documents: DataFrame, **options: float | None) -> DataFrame:
    """(doc_id, source, n_tokens, copies, weight, budget) of every document; copies may be 0 under a given budget."""
    out, name = _scheduled(documents.select("doc_id", "source", "text"), **options)
    return out.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), f"{name}.copies", f"{name}.weight", f"{name}.budget")
