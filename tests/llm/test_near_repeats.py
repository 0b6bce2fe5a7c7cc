"""Near copies whose unshared shingles repeat inside a text (op8), against brute force."""

import random

from llm_helpers import docs  # noqa: F401
from test_brute import near_brute

from casediff.llm import near_dedup


def test_links_between_texts_with_repeats(spark, docs):  # noqa: F811
    rng, texts = random.Random(5), {}
    for i in range(70):
        shared = [f"s{i}x{j}" for j in range(104)]
        for side in range(2):
            own = [f"o{i}x{side}x{j}" for j in range(8 if side or i % 7 else 11)]
            texts[2 * i + side] = " ".join(shared + own * (1 if side and i % 5 == 0 else rng.choice([150, 200])))
    want = near_brute(texts)
    assert 100 > len(set(want.values())) > 70  # some pairs lie below the threshold
    assert {r.doc_id: r.class_id for r in near_dedup.assign(docs(list(texts.items()))).collect()} == want


def test_bands_of_texts_without_repeats_meet_those_with(spark, docs):  # noqa: F811
    once = " ".join(f"w{i}" for i in range(60))
    rows = near_dedup._nodes(near_dedup._texts(docs([(0, once), (1, once + " " + once)]), "doc_id", "text"), 5, 32, 4)
    few, many = sorted((set(r.bands) for r in rows.collect()), key=len)
    assert len(few) == 32 < len(many) <= 64
