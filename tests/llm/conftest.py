import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import docs_of, prose  # noqa: E402


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, copies, repeated rows, near copies, one very long text."""
    base = prose(1, 200)
    near = base[:100] + ["changed"] + base[101:]
    long = " ".join(prose(2, 60_000))
    passage = prose(3, 60)
    return [
        (1, " ".join(base)),
        (2, " \n".join(base)),
        (3, " ".join(near)),
        (4, " ".join(prose(4, 150))),
        (5, None),
        (6, ""),
        (7, " \t\n"),
        (8, "one two"),
        (9, "one  two"),
        (10, long),
        (11, long),
        (12, " ".join(prose(5, 30) + passage + prose(6, 30))),
        (13, " ".join(prose(7, 10) + passage + prose(8, 40))),
        (13, " ".join(prose(7, 10) + passage + prose(8, 40))),
        (None, " ".join(base)),
        (None, None),
        (14, "a" * 300_000),
        (15, " ".join(["ha"] * 500)),
        (16, "ünï 漢字   words"),
        (-3, " ".join(passage)),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return docs_of(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_of(spark, [])
