import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table from (doc_id, text) or longer tuples."""

    def build(rows):
        return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCUMENTS)

    return build


@pytest.fixture(scope="session")
def mixed_rows():
    """Nulls, empty, very long, repeated and tied rows."""
    long_text = " ".join(f"word{i % 97} and{i}" for i in range(60_000))
    line = "This very line is long enough to be looked at, and it stands in many texts."
    rows = [(i, f"{line}\nOwn text number {i} with words of its own here", "en", "a") for i in range(8)]
    return [
        *rows, (100, None, None, None), (101, "", "en", "a"), (None, f"  {line.upper()}  \nno id at all", "en", None), (102, long_text, "en", "b"),
        (103, "one", "fr", "b"), (104, " \t\n\r ", "fr", "b"), rows[0], (105, "ünï çödé " * 30, "de", "c"), (106, "\n\n", "de", "c"),
    ]

