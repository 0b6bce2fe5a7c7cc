"""Templates of labelled and unlabelled URLs (op3 with a column of labels)."""

from casediff.llm import url_templates


def test_labels_decide_the_unlabelled_urls_of_their_template(spark):
    rows = [(i, f"http://h.org/spam/{i}", 1 if i % 2 else None) for i in range(24)]
    rows += [(100 + i, f"http://h.org/good/{i}", 0 if i % 2 else None) for i in range(24)]
    rows += [(200 + i, f"http://h.org/few/{i}", 1 if i < 4 else None) for i in range(24)]  # below min_labels
    rows += [(300, "http://net.net/fr/1", 0), (301, "http://a.com/spam/1", 1)]  # rules go first
    p = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    got = {r.page_id: r.verdict for r in url_templates.judge(p, label="bad").collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(24), 300}
