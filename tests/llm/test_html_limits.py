"""Layout: time and size that grow with the page, a plain twin on generated pages, details, ruby and spans."""

import random
import time

import pytest

from casediff.llm.html_layout import render

PAGES = {
    "nested": "<div>" * 200_000, "quotes": '<a "' * 250_000, "two quotes": "<a '\"x" * 200_000 + ">", "bangs": "<!" * 500_000,
    "wide cell": "<table><tr><td>" + "x" * 100_000 + "<td>y</tr>" + "<tr><td>a<td>b</tr>" * 10_000 + "</table>",
    "lists": "<ul><li>x" * 30_000, "tables": "<table><tr><td>" * 30_000 + "z" * 300_000, "inline": "a <b>x</b>" * 60_000,
    "spans": "<table>" + "<tr><td colspan=1000 rowspan=60000>a" * 3_000,
    "span of wide": "<table><tr>" + ("<td>" + "w" * 32) * 500 + "<tr><td colspan=1000>a" * 5_000,
    "rows of wide": "<table><tr>" + ("<td rowspan=9999>" + "w" * 32) * 300 + "<tr><td>a" * 5_000,
    "selects": "<select>" * 100_000, "raw": "<textarea>" * 100_000, "drawings": "<svg>" * 100_000, "angles": "<" * 1_000_000,
    "cells": "<table>" + "<td>a" * 60_000, "paragraphs": "<p>x" * 100_000, "items": "<ul>" + "<li>x" * 60_000,
}


@pytest.mark.parametrize("name", PAGES)
def test_time_and_size_are_bounded(name):
    began = time.perf_counter()
    text = render(PAGES[name])
    assert time.perf_counter() - began < 20 and len(text) <= 12 * len(PAGES[name])


def test_unclosed_tag_takes_the_rest():
    assert render('one <b>two</b> <a href="x>three</a> four') == "one two"
    assert render("one <!-- two") == "one" and render("a < b <3") == "a < b <3" and render("one </b two") == "one"


def test_details_ruby_and_spans():
    assert render("<details><summary>S</summary>body<p>x</p><summary>T</summary></details>after") == "S\nafter"
    assert render("<details open><summary>S</summary>body</details>") == "S\nbody"
    assert render("<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>") == "漢kan"
    assert render("<ruby>漢<rp>(<rt>kan<rp>)</ruby> x") == "漢kan x"
    rows = render("<table><tr><td rowspan=2>a<td>bbb<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>").split("\n")
    assert [[c.strip() for c in r.split("|")] for r in rows] == [["a", "bbb", "c"], ["", "d", "e"], ["f", "g", "h"]]
    assert len({r.index("|") for r in rows}) == 1


def page(rng, depth):
    """A well-formed tree: (tag, children), or a word."""
    if depth == 0 or rng.random() < 0.3:
        return rng.choice("alpha beta gamma delta".split())
    tag = rng.choice("div div p span b section h2 ul script hide".split())
    if tag == "ul":
        return tag, [("li", [rng.choice("one two three".split())]) for _ in range(rng.randrange(1, 4))]
    inner = 0 if tag in ("p", "h2", "span", "b", "script") else depth - 1
    return tag, [page(rng, inner) for _ in range(rng.randrange(4))]


def html(node):
    if isinstance(node, str):
        return f" {node} "
    tag, children = node
    body = "".join(map(html, children))
    return f"<div hidden>{body}</div>" if tag == "hide" else f"<{tag}>{body}</{tag}>"


def lines_of(node):
    """Words in the line, '' for a new line, '\\n' for a blank line."""
    if isinstance(node, str):
        return [node]
    tag, children = node
    if tag in ("script", "hide"):
        return []
    inner = [x for c in children for x in lines_of(c)]
    if tag == "li":
        return ["", "-", *inner, ""]
    if tag in ("p", "h2", "ul"):
        return ["\n", *inner, "\n"]
    return ["", *inner, ""] if tag in ("div", "section") else inner


def plain(node):
    out, line, gap = [], [], False
    for x in [*lines_of(node), ""]:
        if x not in ("", "\n"):
            line.append(x)
            continue
        if line:
            out += [""] if gap and out else []
            out.append(" ".join(line))
            line, gap = [], False
        gap = gap or x == "\n"
    return "\n".join(out)


def test_equal_a_plain_twin_on_generated_pages():
    rng = random.Random(6)
    for _ in range(400):
        tree = ("div", [page(rng, 4) for _ in range(rng.randrange(1, 6))])
        assert render(html(tree)) == plain(tree), html(tree)
