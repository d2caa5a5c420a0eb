"""Texts and tables shared by the tests."""

import random


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, key string, row string, bucket string, label string"
CLASHES = ("x", None, "y", "z", "b", "l")


def prose(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def docs_of(spark, rows, schema=DOCS):
    """rows: (doc_id, text) or (doc_id, text, source); the rest are columns that clash with own names."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, *CLASHES) for r in rows]
    return spark.createDataFrame(full, schema)
