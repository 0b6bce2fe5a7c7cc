"""Suffix order, nodes and maximal repeats against plain Python."""

import random

import numpy as np
import pytest
from llm_helpers import docs  # noqa: F401

from casediff.llm import substring_dedup


def test_nodes_are_shared_prefixes():
    rng = np.random.default_rng(3)
    symbols = rng.integers(1, 3, size=(60, 6)).astype(np.uint64)
    group = rng.integers(0, 3, size=60)
    sort, shared = substring_dedup.suffix_order(symbols, group)
    keys = [(g, *row) for g, row in zip(group.tolist(), symbols.tolist(), strict=True)]
    assert [keys[i] for i in sort] == sorted(keys)
    for depth in range(7):
        node = substring_dedup.nodes(sort, shared, depth)
        for i in range(60):
            for j in range(60):
                assert (node[i] == node[j]) == (keys[i][:depth + 1] == keys[j][:depth + 1])


def maximal(texts, width):
    """The contract by hand: windows with their first place, joined where both places go on."""
    first, links = {}, {}
    for i in sorted(texts):
        w = texts[i].split()
        for s in range(len(w) - width + 1):
            at = first.setdefault(tuple(w[s:s + width]), (i, s))
            if at != (i, s):
                links[i, s] = at
    out = []
    for (i, s), (j, t) in links.items():
        if links.get((i, s - 1)) == (j, t - 1):
            continue
        n = 0
        while links.get((i, s + n)) == (j, t + n):
            n += 1
        out.append((i, s, n + width - 1, j, t))
    return sorted(out)


@pytest.mark.parametrize("group", [2, 8000])
def test_maximal_repeats(spark, docs, group):
    rng = random.Random(11)
    shared = [" ".join(rng.choices("abcdefgh", k=k)) for k in (20, 35, 70)]
    texts = {}
    for i in range(40):
        parts = [" ".join(rng.choices("abcdefghijkl", k=rng.randrange(30))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(shared))
        texts[i] = " ".join(parts)
    texts |= {40: "x " * 60, 41: "x y " * 40, 42: texts[3] + " z"}
    got = substring_dedup.maximal_repeats(docs(list(texts.items())), group=group)
    assert sorted(map(tuple, got.collect())) == maximal(texts, 20)


def test_a_document_read_twice_is_one(spark, docs):
    rng = random.Random(2)
    once = " ".join(rng.choices("abcdefgh", k=50))
    rows = [(1, once), (1, once), (2, "q " + once), (None, once), (3, None), (4, "")]
    got = substring_dedup.remove_repeats(docs(rows, clash=True)).collect()
    removed = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got)
    assert removed == [(0, 50, 50), (1, 50, 0), (1, 50, 0), (2, 51, 50), (3, 0, 0), (4, 0, 0)]
    spans = substring_dedup.maximal_repeats(docs(rows, clash=True)).collect()
    assert list(map(tuple, spans)) == [(2, 1, 50, 1, 0)]
    assert substring_dedup.maximal_repeats(docs([])).collect() == []
