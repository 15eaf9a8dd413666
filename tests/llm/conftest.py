import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *[T.StructField(c, T.StringType()) for c in ("row", "k", "key", "batch", "fp", "node", "hash", "size", "score", "spans")],
    ]
)
PROSE = ["alpha", "beta", "gamma", "delta", "Épée", "straße", "of", "the", "and", "zeta", "theta", "iota", "kappa", "mu"]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(PROSE) + str(rng.randrange(40)) * (rng.random() < 0.5) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) with columns of clashing names."""

    def make(rows):
        full = [(d, t, None, s, None if t is None else len(t), *["x"] * 10) for d, t, *rest in rows for s in [rest[0] if rest else "s"]]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, repeated rows, ties, blank and very long texts, copies and shared passages."""
    rng = random.Random(3)
    passage = prose(rng, 70)
    long = prose(rng, 6000)
    near = prose(rng, 300)
    rows = [
        (None, passage), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, passage), (5, passage),
        (6, prose(rng, 20) + passage), (7, passage + prose(rng, 30)), (8, long), (9, long), (10, "x y " + long[:9000]),
        (11, near), (12, near.replace("alpha", "ALPHA")), (13, near + " end"), (14, "a " * 400), (15, "a " * 300),
        (-4, prose(rng, 10) + passage[: len(passage) // 2]), (16, "nul \0 byte " + "\0" * 120), (17, "\0" * 120 + "tail"),
    ]
    rows += [(100 + i, prose(rng, rng.randrange(1, 160)) + (passage if i % 5 == 0 else "")) for i in range(30)]
    return rows
