"""The pipeline's stages on nulls, empties, long texts, repeated rows, clashing columns and an empty table."""

from llm_helpers import CLASH, SF, docs  # noqa: F401

import corpus_pipeline


def through(spark, d):
    for name, stage in corpus_pipeline.STAGES:
        before = d.columns
        d = stage(spark, d, SF)
        if name != "packing":
            assert d.columns == before, name
    return d


def test_odd_rows_and_empty_table(spark, docs):
    words = " ".join(f"word{i}" for i in range(400))
    long = " ".join(f"long{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, words), (4, words), (5, words), (6, long), (None, words + " more"), (7, "too short")]
    assert {c for c in CLASH} <= set(docs(rows, clash=True).columns)
    pieces = through(spark, docs(rows, clash=True)).collect()
    assert {p.doc_id for p in pieces} == {4, 6}
    lengths = {p.doc_id: p.doc_tokens for p in pieces}
    assert sum(p.length for p in pieces) == sum(lengths.values())
    assert through(spark, docs(rows).where("false")).collect() == []
