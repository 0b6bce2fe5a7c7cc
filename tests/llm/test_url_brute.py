"""op3 against the same tree grown one node at a time in plain Python."""

import math
import random
import re
from collections import defaultdict

import pytest
from llm_helpers import SF

from casediff.llm import url_templates as U


def host_and_path(url):
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for rule, verdict in U.RULES:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[0]):
                best = rule, verdict
    return best


def segments(path, depth):
    path = re.sub(r"(?<![0-9a-zA-Z])[0-9a-f]{16,}(?![0-9a-zA-Z])", "{x}", path)
    s = [x for x in re.sub("[0-9]+", "{n}", path).split("/") if x]
    return tuple(s if len(s) <= depth else [*s[:depth - 1], "/".join(s[depth - 1:])])


def grown(rows, depth):
    """{(host, path): [template, n, labels, blocks]} from (host, path, label)."""
    t = {}
    for host, path, label in rows:
        r = t.setdefault((host, path), [list(path), 0, 0, 0])
        r[1] += 1
        r[2] += label is not None
        r[3] += label or 0
    for k in range(depth):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (host, _), (template, *counts) in t.items():
            if len(template) > k:
                c = kids[host, *template[:k]][template[k]]
                for i in range(3):
                    c[i] += counts[i]
        turn = {}
        for up, children in kids.items():
            n_all, l_all, b_all = (sum(c[i] for c in children.values()) for i in range(3))
            for seg, (n, labels, b) in children.items():
                rest = l_all - labels
                if len(children) > U.FAN_OUT and n * len(children) <= 2 * n_all:
                    turn[up, seg] = "*"
                elif labels and rest:
                    rate = b_all / l_all
                    spread = math.sqrt(rate * (1 - rate) * (1 / labels + 1 / rest))
                    if abs(b / labels - (b_all - b) / rest) <= U.Z * spread:
                        turn[up, seg] = "{similar}"
        for (host, _), r in t.items():
            if len(r[0]) > k:
                r[0][k] = turn.get(((host, *r[0][:k]), r[0][k]), r[0][k])
    return t


def judged(rows, depth=U.DEPTH, own=False):
    """{id: (host, path, rule, verdict, template, rate)} from (id, url, label); with ``own`` the labels are the rows'."""
    page = {}
    for i, url, label in rows:
        host, path = host_and_path(url)
        rule = rule_of(host, path)
        named = label if own else int(rule[1] == "block") if rule else None
        page[i] = host, path, rule, segments(path, depth), named
    t = grown([(h, s, named) for h, _, _, s, named in page.values()], depth)
    by, of_host, total = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for (host, _), (template, _, labels, blocks) in t.items():
        for c in (by[host, tuple(template)], of_host[host], total):
            c[0] += labels
            c[1] += blocks
    out = {}
    for i, (host, path, rule, s, _) in page.items():
        template = t[host, s][0]
        hl, hb = of_host[host]
        labels, blocks = by[host, tuple(template)]
        host_rate = (hb + U.STRENGTH * total[1] / (total[0] or 1)) / (hl + U.STRENGTH)
        rate = (blocks + U.STRENGTH * host_rate) / (labels + U.STRENGTH)
        learned = "block" if labels >= U.MIN_LABELS and rate >= U.PURITY else "allow"
        out[i] = (host, path, rule and rule[0], rule[1] if rule else learned, "/" + "/".join(template), rate)
    return out


def same(df, want):
    got = {r.page_id: r for r in df.collect()}
    assert got.keys() == want.keys()
    for i, (*exact, rate) in want.items():
        r = got[i]
        assert [r.host, r.path, r.rule, r.verdict, r.template] == exact
        assert r.block_rate == pytest.approx(rate, rel=1e-12)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    same(U.op3(spark, sf), judged([(r.page_id, r.url, None) for r in rows]))


@pytest.mark.parametrize("seed", [1, 2])
def test_labelled_trees(spark, seed):
    rng = random.Random(seed)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    bad = {(h, a): rng.random() ** 2 if rng.random() < 0.5 else 1.0 for h in range(4) for a in range(6)}
    rows = []
    for i in range(1500):
        # the first host has half of all pages
        h, a = rng.choice((0, 0, 0, 0, 1, 2, 3)), rng.randrange(6)
        tail = rng.choice((f"{rng.randrange(999)}", rng.choice(names), f"{rng.choice(names)}/{rng.getrandbits(80):020x}",
                           "/".join(rng.choices("pq", k=rng.randrange(20)))))
        label = int(rng.random() < bad[h, a]) if rng.random() < 0.6 else None
        rows.append((i, f"http://H{h}.org/s{'abcdef'[a]}/{tail}?x={i}", label))
    rows += [(2000, None, 1), (2001, "no address", 0), (2002, "http://a.example.com/en/1", None), (2003, "x://", None),
             (2004, "http://net/fr/" + "d/" * 300, 0), (2005, rows[0][1], rows[0][2])]
    want = judged(rows, own=True)
    assert {"block", "allow"} == {v[3] for v in want.values() if v[2] is None}
    assert any("{similar}" in v[4] for v in want.values()) and any("*" in v[4] for v in want.values())
    p = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    same(U.judge(p, label="bad"), want)
