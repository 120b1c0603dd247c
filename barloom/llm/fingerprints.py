"""Document fingerprints by content-defined chunking.

A gear hash runs over the bytes of a text; a chunk ends where its low bits are zero, with more bits
asked for before the normal length and fewer after it, so that lengths gather around it. Boundaries
depend on nearby bytes alone, so an edit or a shift only changes the chunks around it. A fingerprint
is the set of chunk digests with the bytes they stand for; how much of one document another one holds
is the share of its bytes in chunks that both have.

Defined cases: a null text is an empty one, with an empty fingerprint; likeness is 1 for equal
fingerprints and 0 if just one of them is empty; rows follow each other by id in descending order,
null ids last, and rows that repeat an id by their text; the row after the last is the first; an
empty table gives an empty result; other columns are ignored. ``report`` orders by number, so ids that
aren't whole numbers raise a ``TypeError`` before anything runs; ``fingerprint`` takes ids of any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import bodies

LEAST, NORMAL, MOST = 8, 32, 128  #: bytes in a chunk
_HARD, _EASY = np.uint32(0x3F << 20), np.uint32(0x07 << 20)  # 6 and 3 bits: one more and two less than log2(NORMAL)
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint32)


def _gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the gear values of the last 32 bytes, each shifted
    by its distance; it is built by doubling the span."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        h[span:] += h[:-span] << np.uint32(span)
    return h


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _gear(np.frombuffer(data, dtype=np.uint8))
    easy = np.flatnonzero((h & _EASY) == 0) + 1
    hard = easy[(h[easy - 1] & _HARD) == 0]
    hard_at, easy_at = [*hard.tolist(), n + MOST], [*easy.tolist(), n + MOST]
    out, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        while hard_at[i] <= start + LEAST:
            i += 1
        end = hard_at[i]
        if end > start + NORMAL:
            while easy_at[j] <= start + NORMAL:
                j += 1
            end = min(easy_at[j], start + MOST)
        if end >= n:
            break
        out.append(end)
        start = end
    return [*out, n]


def chunks(data: bytes) -> dict[int, int]:
    """Digest of each chunk to the bytes it stands for in ``data``."""
    found: dict[int, int] = {}
    digest, start = xxhash.xxh32_intdigest, 0
    for end in cuts(data):
        d = digest(data[start:end])
        found[d] = found.get(d, 0) + end - start
        start = end
    return found


def encoded(found: dict[int, int]) -> str:
    """A fingerprint as text: digest (8 hex digits), colon, bytes (hex), in order of the digest."""
    return ",".join([f"{d:08x}:{n:x}" for d, n in sorted(found.items())])


def decoded(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in fingerprint.split(",") if x)}


def likeness(one: dict[int, int], other: dict[int, int]) -> float:
    """Containment: the share of the bytes of ``one`` in chunks that ``other`` has as well."""
    if one == other:
        return 1.0
    total = sum(one.values())
    if not total or not other:
        return 0.0
    return sum([min(n, other[d]) for d, n in one.items() if d in other]) / total


def fingerprint(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoded(chunks(t or b"")) for _, texts in bodies(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    schema = T.StructType([documents.schema["doc_id"], T.StructField("fingerprint", T.StringType())])
    return documents.select("doc_id", "text").mapInArrow(made, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of runs of ids, in order, each with the row after it; a run's tail is only looked at."""
    last = None  # run, tail, doc_id, body, chunks
    for batch, a, texts in ((batch, a, texts) for batch in batches for a, texts in bodies(batch.column("text"))):
        out = []
        for run, tail, doc_id, body in zip(*(batch.column(c).slice(a, len(texts)).to_pylist() for c in ("run", "tail", "doc_id")), texts):
            body = body or b""
            found = last[4] if last is not None and last[3] == body else chunks(body)
            if last is not None and last[0] == run and not last[1]:
                out.append(_row(*last[2:], body, found))
            last = (run, tail, doc_id, body, found)
        kinds = [batch.column("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], ["doc_id", *(x.split()[0] for x in _REPORT.split(", "))])


def _row(doc_id: object, own: bytes, own_set: dict[int, int], following: bytes, next_set: dict[int, int]) -> tuple:
    text = own.decode()
    changed = edited(text, following.decode()).encode()
    changed_set = own_set if changed == own else chunks(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), encoded(own_set), encoded(changed_set), likeness(own_set, changed_set), likeness(own_set, next_set)


_REPORT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run_of(bounds: list[int]) -> tuple[Column, Column]:
    """How many of the descending ``bounds`` are over the id, found in two steps of their root's size;
    the first step's result is looked up as column ``coarse``."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[a : a + step] for a in range(0, len(bounds), step)]
    above = lambda xs: F.size(F.filter(xs, lambda b: b > F.col("doc_id")))
    coarse = above(F.array(*[F.lit(g[-1]) for g in groups]))
    fine = above(F.coalesce(F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.col("coarse")), F.array().cast("array<bigint>")))
    return coarse, F.least(F.col("coarse") * step + fine, F.lit(len(bounds)))


def report(documents: DataFrame, runs: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like it is to that and to the next.

    Documents are dealt into ``runs`` by ranges of their integer id; the text moves once. The first
    row of a run goes to the end of the run before it as well, so that every row meets the next. Only
    the bounds and the first ids of the runs come to the driver.
    """
    if not isinstance(documents.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id has to be a whole number, as rows follow each other by it")
    spark = documents.sparkSession
    light = documents.select("doc_id", "text")
    runs = runs or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = documents.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)] or [0.5], max(10_000, 20 * runs))).first()[0]
    bounds = sorted(set(at or []), reverse=True) if runs > 1 else []
    if bounds:
        coarse, run = _run_of(bounds)
        light = light.withColumn("coarse", coarse)
    else:
        run = F.lit(0)
    dealt = light.select("doc_id", "text", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(run).cast("int").alias("run"))
    firsts = {r.run: r.first for r in dealt.groupBy("run").agg(F.max("doc_id").alias("first")).collect()}
    order = sorted(firsts)
    first_of = F.array(*[F.lit(firsts.get(r)).cast("bigint") for r in range(len(bounds) + 2)])
    before = F.array(*[F.lit(order[order.index(r) - 1] if r in firsts else None).cast("int") for r in range(len(bounds) + 2)])
    place = lambda r, tail: F.struct(r.alias("run"), F.lit(tail).alias("tail"))
    is_first = F.col("doc_id").eqNullSafe(F.get(first_of, F.col("run")))
    places = F.when(is_first, F.array(place(F.col("run"), False), place(F.get(before, F.col("run")), True))).otherwise(F.array(place(F.col("run"), False)))
    sent = dealt.select("doc_id", "text", F.explode(places).alias("place")).select("place.run", "place.tail", "doc_id", "text")
    runs_in_order = sent.repartition("run").sortWithinPartitions("run", "tail", F.desc_nulls_last("doc_id"), "text")
    schema = T.StructType([documents.schema["doc_id"], *T.StructType.fromDDL(_REPORT)])
    return runs_in_order.mapInArrow(_paired, schema)
