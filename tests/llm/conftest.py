import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, **columns):
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, size long, label string, key string, blob string, _id long, _gone long, _bad long, _sha string, fp long, p string"
        return spark.createDataFrame([(i, t, columns.get("lang", {}).get(i), "s", len(t or ""), 1, 2, 3, "x", "k", "b", 4, 5, 6, "y", 7, "z") for i, t in rows], schema)

    return make


@pytest.fixture
def odd(frame):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (4, "word"), (None, "no id here"), (5, "a b"), (6, "long " * 30_000), (7, "x" * 100_000), (8, "É ÀÇ ß 日本 😀 ▁ end"), (9, "a b")]
    return frame(rows)
