import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river rose by two metres overnight and the lower road was closed before dawn while nobody had expected the old bridge to hold"


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text) or (doc_id, text, source)."""

    def made(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows], SCHEMA)

    return made


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"{PROSE} number {k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, PROSE), (5, PROSE), (6, PROSE), (None, PROSE), (None, None), (7, "Ünïcödé ñandú 日本語 🙂 text"), (8, "\n\n\n"), (9, "one")]
    return docs([(i, t, None if k % 3 else "s0") for k, (i, t) in enumerate(rows)])


@pytest.fixture
def none(docs):
    return docs([])


def clashing(frame):
    """The same with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("score", "found", "flags", "body", "fp", "mix", "key", "gone_id", "vslot", "copy", "text_hash", "own_hash", "label", "run", "size", "n")
    return frame.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
