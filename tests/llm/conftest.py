import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("driver data not present")
    return SMALL


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) tuples, with a clashing and an extra column on demand."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("size", "score", "shard", "slot", "spans", "items", "n_words", "base", "kept", "node", "sig"):
                df = df.selectExpr("*", f"'mine' AS {name}")
        return df

    return make
