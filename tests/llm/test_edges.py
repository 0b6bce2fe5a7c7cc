"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from llm_helpers import CLASH, docs  # noqa: F401
from pyspark.sql import functions as F

from casediff.llm import (
    decontaminate,
    html_layout,
    near_dedup,
    packing,
    quality,
    secrets,
    substring_dedup,
    token_counts,
    url_templates,
    warc,
)
from casediff.session import scratch_path

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (None, "some text without an id"), (5, "a b c"), (5, "a b c"),
        (5, "another text, same id"), (6, "é ü 😀 " * 50)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word10 word11 word12 word13 word14 word15 word16 word17 word18 word19 word20"),
                                  (2, None), (3, ""), (4, "same id"), (4, "same id")], "item_id bigint, text string")


def runs(spark, items):
    return {
        "packing": packing.pack,
        "substring": substring_dedup.remove_repeats,
        "counts": lambda d: token_counts.count_tokens(d, scratch_path(spark, "cache")),
        "decontaminate": lambda d: decontaminate.report(d, items),
        "near": near_dedup.assign,
        "quality": quality.quality,
        "secrets": secrets.find_secrets,
    }


NAMES = ("packing", "substring", "counts", "decontaminate", "near", "quality", "secrets")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, items, name):
    out = runs(spark, items)[name](docs(ROWS, clash=True))
    ids = sorted((r[0] for r in out.select("doc_id").collect()), key=str)
    if name == "packing":
        assert set(ids) == {i for i, _ in ROWS}
    else:
        assert ids == sorted((i for i, _ in ROWS), key=str)
    plain = runs(spark, items)[name](docs(ROWS))
    if name != "packing":
        assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, items, name):
    assert runs(spark, items)[name](docs([])).count() == 0


def test_filters_keep_columns(spark, docs, items):
    d = docs([(i, f"clean text number {i} has enough of these plain words to stay in {'abcdefgh'[i]}") for i in range(8)]
             + ROWS, clash=True)
    for out in (quality.keep_good(d), near_dedup.keep_one(d), decontaminate.drop_contaminated(d, items),
                secrets.redact(d), decontaminate.remove_spans(d, items)):
        assert out.columns == d.columns
        assert out.where("doc_id = 3 and text like 'clean%'").count() == 1
        assert all(r[c] == 7 for r in out.collect() for c in CLASH)
        empty = docs([], clash=True)
    for out in (quality.keep_good(empty), near_dedup.keep_one(empty), decontaminate.drop_contaminated(empty, items),
                secrets.redact(empty)):
        assert out.columns == d.columns and out.count() == 0


PAGES = [(1, None, None), (2, "http://a.b/c", ""), (3, "no scheme", "<p>x"), (None, "HTTP://EX.com", "<p>y"),
         (4, "http://x.net/es/1\r\nX: y", "é" * 3000), (5, "http://x.net/es/2", "é" * 3000),
         (5, "http://x.net/es/2", "é" * 3000), (6, "", "<div>" * 3000 + "deep")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 7, 7, 7) for r in rows],
                                 "page_id bigint, url string, html string, digest int, host int, text int")


def test_pages_odd_rows(spark):
    p = pages(spark)
    for out in (warc.read_records(warc.archive(p, scratch_path(spark, "w"))), url_templates.judge(p), html_layout.extract(p)):
        assert sorted((r[0] for r in out.select("page_id").collect()), key=str) == sorted((r[0] for r in PAGES), key=str)
    none = pages(spark, [])
    for out in (warc.read_records(warc.archive(none, scratch_path(spark, "w"))), url_templates.judge(none),
                html_layout.extract(none)):
        assert out.count() == 0


def test_warc_round_trip(spark):
    index = warc.archive(pages(spark), scratch_path(spark, "w"))
    assert index.agg(F.countDistinct("file", "offset")).first()[0] == len(PAGES)
    got = {(r.page_id, r.record_type): r for r in warc.read_records(index, gap=0, most=1).collect()}
    assert got[5, "response"].payload.decode() == "é" * 3000 and got[5, "response"].payload_bytes == 6000
    revisit = got[4, "revisit"]
    assert revisit.refers_to == 5 and revisit.payload is None and revisit.payload_bytes == 6000
    assert revisit.payload_digest == got[5, "response"].payload_digest
    assert "\r" not in revisit.url and index.where("page_id = 4").first().url.endswith("\r\nX: y")
    assert [r.page_id for r in warc.select(index, F.col("url") == "http://a.b/c").collect()] == [2]


def test_url_rules(spark):
    urls = {1: ("http://EXAMPLE.com/en/1", "example.com/en/"), 2: ("http://www.example.com/en/1?x", "www.example.com/en/"),
            3: ("http://a.www.example.com/en/", "www.example.com/en/"), 4: ("http://example.com", None),
            5: ("http://notexample.com/en/", "com/"), 6: ("x://b.net/es/#f", "net/es/"), 7: ("b.net/es/", None),
            8: ("http://b.net/es", None)}
    p = spark.createDataFrame([(k, u) for k, (u, _) in urls.items()], "page_id bigint, url string")
    assert {r.page_id: r.rule for r in url_templates.judge(p).collect()} == {k: r for k, (_, r) in urls.items()}


def test_url_templates_learn(spark):
    known = [(i, f"http://h.org/spam/{i}", 1) for i in range(20)] + [(100 + i, f"http://h.org/good/{i}", 0) for i in range(20)]
    new = [(200, "http://h.org/spam/999", None), (201, "http://h.org/good/999", None), (202, "http://h.org/new/1", None)]
    p = spark.createDataFrame(known + new, "page_id bigint, url string, bad int")
    got = {r.page_id: r.verdict for r in url_templates.judge(p, rules=(), label="bad").collect()}
    assert (got[200], got[201], got[202]) == ("block", "allow", "allow")
    same = [(i, f"http://h.org/{c}/x", 1) for i, c in enumerate("abcdefgh" * 5)]
    tree = url_templates.grow(spark.createDataFrame(same, "page_id bigint, url string, label int").select(
        F.lit("h").alias("host"), F.split(F.regexp_extract("url", "org/(.*)", 1), "/").alias("segments"), "label"))
    assert {tuple(r.template) for r in tree.collect()} == {("{similar}", "x")}
    wild = [(F"u{i}x", None) for i in range(40)]
    tree = url_templates.grow(spark.createDataFrame(wild, "s string, label int").select(
        F.lit("h").alias("host"), F.array("s").alias("segments"), "label"))
    assert {tuple(r.template) for r in tree.collect()} == {("*",)}


def test_html():
    page = ("<head><title>no</title></head><h1>A &amp; B</h1><p>one<p>two <b>bold</b> end<br>next<ul><li>a<li>b<ol><li>x"
            "<li>y</ol></ul><table><tr><th>Name<th>Qty<tr><td>Apple<td>1</table><div hidden>no</div>"
            "<div style='display: none'>no<div>no</div></div><pre> k\n  z</pre><script>var a='</p>';</script>tail</i>")
    assert html_layout.render(page) == (
        "A & B\n\none\n\ntwo bold end\nnext\n\n- a\n- b\n  1. x\n  2. y\n\nName  | Qty\nApple | 1\n\n k\n  z\n\ntail")
    assert html_layout.render("<td>x</td><a href='") and html_layout.render("<!-- open") == ""


def test_archives_are_read_in_as_many_tasks_as_chunks(spark):
    from pyspark.sql import functions as F
    rows = [(i, f"http://h/{i}", "".join(chr(97 + (i * j * j) % 26) for j in range(3000))) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    index = warc.archive(pages, scratch_path(spark, "warc"))
    size = index.agg(F.sum("length")).first()[0]
    back = warc.read_records(index, chunk=8 << 10)
    assert back.rdd.getNumPartitions() == -(-size // (8 << 10)) > 4
    assert back.count() == 200


def test_nothing_is_contaminated_without_a_benchmark(spark, docs, items):
    d = docs(ROWS)
    for none in (items.where("false"), items.where("item_id in (2, 3)")):
        out = decontaminate.report(d, none).collect()
        assert len(out) == len(ROWS) and not any(r.contaminated or r.n_items for r in out)
        assert decontaminate.drop_contaminated(d, none).count() == len(ROWS)
    assert decontaminate.report(d.where("false"), items).count() == 0
