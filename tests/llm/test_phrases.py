"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from casediff.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n int, k int, fp int"


def brute(rows, min_count, top, longest=5):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if a >= min_count and len(key[1]) > 1}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i:i + k]] = max(inside[lang, w[i:i + k]], a)
    out = []
    for (lang, w), a in cand.items():
        if inside[lang, w] >= a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, got = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            got.append((r[0], rank[r[0]], *r[1:]))
    return got


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 7, 7) for r in rows], SCHEMA)


def result(df):
    return sorted(tuple(r)[:8] for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = []
    for i in range(120):
        words = [rng.choice("a b c d Ä é Bb cc dd 日 x-y".split()) for _ in range(rng.randrange(60))]
        seps = [rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for _ in words]
        made.append((i, "".join(w + s for w, s in zip(words, seps, strict=True)), rng.choice(["en", "en", "fr", None, "und"])))
    return made + [(5, None, "en"), (None, "a b a b a b a b", "en"), (7, "", None), (8, " . ,\n", "xx"), (9, "A a a A " * 30, "en")]


@pytest.mark.parametrize("block", [phrases.BLOCK, 16])
def test_equal_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    want = sorted(brute(rows, 6, 40))
    assert len(want) > 60
    assert result(phrases.collocations(table(spark, rows).repartition(3), min_count=6, top=40)) == want


def test_nothing_frequent_and_empty(spark, rows):
    assert result(phrases.collocations(table(spark, rows), min_count=10**6)) == []
    assert result(phrases.collocations(table(spark, rows).where("false"))) == []


def test_pointer_leads_to_the_phrase(spark, rows):
    by_id = {r[0]: r[1] for r in rows[:120]}
    for r in phrases.collocations(table(spark, rows[:120]), min_count=6, top=40).collect():
        words = re.findall("[^.,;:!?\x0a-\x0d\x20\x09]+", re.sub("[A-Z]", lambda m: m[0].lower(), by_id[r.doc_id]))
        assert " ".join(words[r["at"]:r["at"] + len(r.phrase.split(" "))]) == r.phrase


def test_full_bit_tables_change_nothing(spark, rows):
    """Few bits let nearly every run through: the counts by phrase stay exact."""
    assert result(phrases.collocations(table(spark, rows), min_count=6, top=40, bits=16)) == sorted(brute(rows, 6, 40))


@pytest.mark.parametrize("rows_of", [1, 1000])
def test_collisions_are_told_apart(rows, rows_of):
    """Words whose fingerprints nearly all collide: counts by phrase stay exact, within a block and across blocks."""
    import pyarrow as pa
    texts = [r for r in rows if r[1]][:60]
    langs = sorted({r[2] or "und" for r in texts})
    written = phrases.Written()
    for i in range(0, len(texts), rows_of):
        part = texts[i:i + rows_of]
        lang = np.array([langs.index(r[2] or "und") for r in part])
        for block in phrases._blocks(pa.array([r[1] for r in part])):
            few = (block.end - block.start).astype(np.uint64) % np.uint64(2)
            runs = [(k, block.places(k), np.ones(len(block.places(k)), dtype=bool)) for k in range(1, 6)]
            written.add(block, runs, lang[block.doc], few, np.arange(len(part)), np.zeros(len(part), dtype=bool))
    got = Counter()
    for batch in written.rows(langs):
        for r in batch.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    want = Counter()
    for _, text, lang in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]+", lambda m: m[0].lower(), text)):
            w = re.findall("[^\x20\x09]+", piece)
            want.update((lang or "und", " ".join(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert got == want and written.by_text is not None


def test_long_text_in_parts(spark):
    text = "one two three four five. " * 60_000 + "x" * 700_000 + " one two"
    got = {r.phrase: r.a for r in phrases.collocations(table(spark, [(1, text, "en")])).collect()}
    assert got == {"one two three four five": 60_000, "one two": 60_001}
