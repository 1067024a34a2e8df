import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_conftest import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty, blank, one-letter and very long texts, ties, repeated rows."""
    long = prose(1, 40_000)
    texts = [None, "", "   \n", "a", "Ab cD", long, prose(2, 60), prose(2, 60), prose(2, 60) + " more words", "<|endoftext|> x", "mail a.b@c.org or 10.0.0.1, +1 (212) 555-0101"]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], (20, None, None, None, None), (21, prose(3, 30), None, "s", 1), (None, prose(4, 30), "xx", None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with more columns of clashing names."""
    return spark.createDataFrame([(*r, 7, "x", "x", "x", "x", "x", "x") for r in odd_rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
