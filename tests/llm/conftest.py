import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

EDGE = [(1, None, "src1"), (2, "", "src1"), (3, "one", None), (4, "one two", "src2"), (4, "one two", "src2"), (5, "One TWO three", "é"),
        (6, "one two three", "src2"), (None, "one", "src2"), (8, "x" * 30_000, "src1"), (9, "a b c d " * 4000, "src2"),
        (10, " \t\n ", None), (11, "Ä ä Ä", "src1"), (-3, "one", None), (12, "tail▁mark 🎉", "z")]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(i, t, None if i == 5 else "en", s, None, f"x{i}", 1, 2, "q") for i, t, s in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "digest string, fp long, size long, block string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_rows(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
