import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) tuples, with an extra column whose names clash."""
    def build(rows, extra="shard string, size string, row string, sequence_id string"):
        full = [(*r, None if r[1] is None else len(r[1]), "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, f"{FIELDS}, {extra}")
    return build
