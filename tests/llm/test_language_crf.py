"""The conditional random field against plain enumeration, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from llm_helpers import docs  # noqa: F401

from casediff.llm import language_crf as crf

SF = "/root/testdata/sf0.01"
LEFT = {"en": "the cat and dog sat on mat with thing", "fr": "le chat et les chiens sur une été où", "de": "der hund und die straße über ich nicht"}


def toy_model(epochs=4):
    rng = random.Random(1)
    langs = sorted(LEFT)
    segments = [(y, rng.choices(LEFT[name].split(), k=12)) for y, name in enumerate(langs) for _ in range(60)]
    return crf.fit(segments, langs, epochs)


def enumerated(model, words):
    """Posteriors by summing over all labellings."""
    k = len(model.langs)
    pot, moves, start = np.exp(model.potentials(words)), np.exp(model.moves), np.exp(model.start)
    total = np.zeros((len(words), k))
    for path in itertools.product(range(k), repeat=len(words)):
        p = start[path[0]] * np.prod([pot[i, y] for i, y in enumerate(path)])
        p *= np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
        for i, y in enumerate(path):
            total[i, y] += p
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("stretch,span", [(64, 1 << 17), (2, 4), (1, 1)])
def test_forward_backward_equals_enumeration(monkeypatch, stretch, span):
    monkeypatch.setattr(crf, "STRETCH", stretch)
    monkeypatch.setattr(crf, "SPAN", span)
    model = toy_model(1)
    texts = ["the chat sat über und dog les", "le", "", None, "12 ² 3", "dog été straße", "zzz qqq le le le le"]
    sums, n = crf._expected_words(crf.Memory(model), crf.Chain(model), texts)
    for t, s, c in zip(texts, sums, n, strict=True):
        words = [w for w in crf.WORD.findall((t or "").lower()) if any(x.isalpha() for x in w)]
        assert c == len(words)
        assert np.allclose(s, enumerated(model, words).sum(0) if words else 0, atol=1e-6)


def test_gradient(monkeypatch):
    """Expected transitions and posteriors of padded sequences equal those of the enumeration."""
    model = toy_model(1)
    words = "the chat und dog".split()
    pot = np.ones((2, 6, 3))
    pot[0, :4] = crf._scaled(model.potentials(words))
    pot[1, :2] = crf._scaled(model.potentials(words[:2]))
    real = np.array([[True] * 4 + [False] * 2, [True] * 2 + [False] * 4])
    post, moved = crf._marginals(pot, np.exp(model.moves), np.exp(model.start), real)
    assert np.allclose(post[0, :4], enumerated(model, words), atol=1e-6)
    assert np.allclose(post[1, :2], enumerated(model, words[:2]), atol=1e-6)
    assert abs(moved.sum() - 4) < 1e-9


def test_words_of_pieces(monkeypatch):
    text = "Ein Wort, noch_eins 12x yé ²" * 20
    whole = [w for some in crf.words_of(text) for w in some]
    monkeypatch.setattr(crf, "PIECE", 5)
    assert [w for some in crf.words_of(text) for w in some] == whole


def test_code_switched_text():
    model = toy_model()
    got = crf.label_words(model, "the cat and dog sat; le chat et les chiens 5 der hund und die straße")
    assert [y for _, y, _ in got] == ["en"] * 5 + ["fr"] * 5 + ["de"] * 5
    assert all(0 <= p <= 1 for _, _, p in got)


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = crf.op11(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_only_text_and_training_labels_matter(spark):
    """Labels of held-out rows, sources and ids change no prediction."""
    from pyspark.sql import functions as F
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = d.withColumn("lang", F.when(crf.held_out(), F.lit("en")).otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    one, two = (crf.predict(x.select("doc_id", "text"), crf.train(x.where(~crf.held_out()))) for x in (d, other))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_switch_points(spark):
    """Half of one held-out text and half of another: the words change language where the texts do."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = crf.train(d.where(~crf.held_out()))
    held = [r for r in d.where(crf.held_out()).orderBy("doc_id").collect() if len(r.text or "") > 600 and r.text.upper() != r.text]
    by_lang = {x: [r for r in held if r.lang == x] for x in ("en", "fr", "de", "es")}
    right = total = 0
    for a, b in zip(by_lang["en"], by_lang["fr"] + by_lang["de"] + by_lang["es"], strict=False):
        parts = [crf.WORD.findall(x.text[:500].lower())[1:-1] for x in (a, b)]
        got = [y for _, y, _ in crf.label_words(model, " ".join(parts[0] + parts[1]))]
        right += sum(y == w for y, w in zip(got, [a.lang] * len(parts[0]) + [b.lang] * len(parts[1]), strict=True))
        total += len(got)
    assert total > 1000 and right > 0.93 * total


def test_odd_rows(spark, docs):
    long = " ".join(f"the{chr(97 + i % 26)} dog" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " 12 ²\n"), (4, long), (None, "some text"), (5, "a b"), (5, "a b"), (6, "日本語 " * 40)]
    d = docs(rows, clash=True)
    out = crf.predict(d, crf.train(d.where("doc_id is not null")))
    got = {(r.doc_id, r.lang_pred) for r in out.collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (5, "en"), (6, "en")}
    assert crf.predict(d.where("false"), None).collect() == []
    assert {(r.lang_pred, r.score) for r in crf.predict(d, None).collect()} == {("und", 0.0)}
    assert crf.train(d.where("false")) is None and crf.train(d.where("doc_id = 3")) is None
