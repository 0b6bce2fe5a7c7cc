"""Shared by the tests of the corpus operators."""

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, with columns whose names clash with the operators' own."""
    def make(rows, clash=False):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        if not clash:
            return spark.createDataFrame(full, DOCS)
        more = ", ".join(f"{c} int" for c in CLASH)
        return spark.createDataFrame([r + (7,) * len(CLASH) for r in full], f"{DOCS}, {more}")
    return make


CLASH = ("t", "w", "h", "digest", "node", "ord", "row", "spans", "n", "label", "band", "fence", "kept", "pos", "items")
