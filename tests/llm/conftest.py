import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Frames of documents with two extra columns whose names the operators use inside."""

    def make(*rows):
        rows = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        return spark.createDataFrame([(*r, "extra", 7) for r in rows], DOCS + ", row string, size int")

    return make
