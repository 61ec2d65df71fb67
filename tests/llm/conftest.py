import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""
    def make(rows, extra: bool = False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if extra:       # columns with the names that the operators give to theirs
            for c in ("score", "kept", "h", "n", "rep", "component_id", "items", "spans", "block", "line", "x", "y", "key"):
                df = df.selectExpr("*", f"'mine' AS {c}")
        return df
    return make
