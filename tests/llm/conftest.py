import os

import pytest

pytest.importorskip("brinelink.llm")

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, source[, lang]]) with clashing extra columns."""

    def make(rows, parts=3):
        rows = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
        schema = (
            "doc_id long, text string, source string, lang string, n_chars long, fp long, queue string, "
            "n string, a string, b string, key string, component string, uid string, k string, pid string, at string, "
            "rk string, lo string, hi string, id string, other string, prk string, part string, hash string, h string"
        )
        full = [(r[0], r[1], r[2], r[3], 1, None) + ("x",) * 19 for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
