"""Pair-bound MaxScore against scoring every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from casediff.llm import ranked_search as rs

DOCS = "doc_id bigint, text string, rank int, score int, q int, ids int, item_id int"
ITEMS = "item_id bigint, text string, doc_id int, score int, q int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    lists = [(i, terms(t)) for i, t in docs]
    n = sum(bool(w) for _, w in lists)
    length = sum(len(w) for _, w in lists)
    df = {t: sum(t in set(w) for _, w in lists) for _, x in items for t in terms(x)}
    out = []
    for item, text in items:
        scored = []
        for i, w in lists:
            m = 100 - 25 + 25 * len(w) * n // length if w else 1
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 12 * m))
                    for t in terms(text))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (spark.createDataFrame([(*d, 1, 2, 3, 4, 5) for d in docs], DOCS),
            spark.createDataFrame([(*i, 1, 2, 3) for i in items], ITEMS))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["É", "日本", "B2b"] * 40
    docs = [(i, rng.choice([" ", "-", ". "]).join(rng.choices(words, k=int(rng.expovariate(1 / 25))))) for i in range(300)]
    docs += [(400, None), (401, ""), (402, " .-"), (None, "w1 w2 B2B"), (403, "w1 w2 b2b"), (3, docs[3][1]), (404, "w1 w2 b2b")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for i in range(40)]
    return docs, items + [(90, None), (91, ""), (92, "nowhere"), (5, "w1 w1 w2"), (93, "W1 é É 日本")]


@pytest.mark.parametrize("how", ["one segment", "many segments", "query blocks", "long pieces"])
def test_equal_brute_force(spark, corpus, how, monkeypatch):
    docs, items = tables(spark, *corpus)
    docs = docs.repartition(5) if how != "one segment" else docs.coalesce(1)
    more = {"block_terms": 30} if how == "query blocks" else {}
    if how == "many segments":
        monkeypatch.setattr(rs, "SEGMENT_DOCS", 7)
    if how == "long pieces":
        monkeypatch.setattr(rs, "PIECE", 3)
    for top in (3, 20):
        assert result(rs.rank_documents(docs, items, top=top, **more)) == brute(*corpus, top)


def test_empty_sides(spark, corpus):
    docs, items = tables(spark, *corpus)
    assert result(rs.rank_documents(docs.where("false"), items)) == []
    assert result(rs.rank_documents(docs, items.where("false"))) == []
    assert result(rs.rank_documents(docs.where("doc_id = 402"), items)) == []


def test_pair_bounds_skip_more_than_term_bounds(spark):
    """Rare terms that seldom meet: joint maxima leave out postings that the terms' own maxima cannot."""
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "benchmark"))
    from collections import Counter
    queries = [(r.item_id, Counter(t.encode() for t in terms(r.text))) for r in items.where("item_id < 60").collect()]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in queries))))}
    asked = [(q, sorted((vocabulary[t], n) for t, n in c.items())) for q, c in queries]
    index = rs.build(docs.coalesce(1), vocabulary)
    n, length, df = rs.statistics(index)
    weights = np.array([rs.weight(n, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    named, own = rs.pair_up(asked, weights)
    weighed = rs.weigh(index, n, length, weights, named)
    least = rs.thresholds(weighed, asked, own, 20)
    (row,) = weighed.collect()
    s = rs.Segment(row.asDict())
    every = pair = term = 0
    for (q, t), numbers in zip(asked, own, strict=True):
        d, score, read = rs.best(s, t, numbers, named, 20, least.get(q, 0))
        d2, score2, read2 = rs.best(s, t, numbers, named, 20, least.get(q, 0), by_pair=False)
        d3, score3, read3 = rs.best(s, t, numbers, named, 20, 0)
        pairs = [dict(zip(x.tolist(), y.tolist(), strict=True)) for x, y in ((d, score), (d2, score2), (d3, score3))]
        assert pairs[0] == pairs[1] == pairs[2]
        assert (score >= least.get(q, 0)).all()
        pair, term, every = pair + read, term + read2, every + read3
    assert pair < term < every
    print(pair, term, every)


def test_pair_lists(spark, corpus):
    docs, _ = tables(spark, *corpus)
    vocabulary = {b"w1": 0, b"w2": 1, b"w3": 2, b"none": 3}
    index = rs.build(docs.coalesce(1), vocabulary)
    n, length, df = rs.statistics(index)
    weights = np.array([rs.weight(n, df.get(i, 0)) for i in range(4)], dtype=np.int64)
    (row,) = rs.weigh(index, n, length, weights, [(0, 1), (1, 2), (0, 3)]).collect()
    s = rs.Segment(row.asDict())
    for number, (a, b) in enumerate([(0, 1), (1, 2), (0, 3)]):
        lists = [set(s.docs[s.postings(s.place(t))].tolist()) if s.place(t) >= 0 else set() for t in (a, b)]
        both = s.pair_docs[s.pair_starts[number]:s.pair_starts[number + 1]]
        assert set(both.tolist()) == lists[0] & lists[1]
        up = np.sort(both)
        sums = (s.added(s.place(a), up) + s.added(s.place(b), up))[np.searchsorted(up, both)] if len(both) else np.zeros(1, dtype=np.int64)
        assert s.joint[number] == sums.max() and (np.diff(sums) <= 0).all()
    assert isinstance(row.joint, (bytes, bytearray)) and pa.__version__
