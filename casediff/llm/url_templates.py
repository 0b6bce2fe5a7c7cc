"""URL filters from rules and a path-template tree (native).

Rules such as ``example.com/en/`` decide first.  A rule fits its host and all
subdomains of it, if the URL's path starts with the rule's; the longest wins.

The other URLs are judged by templates learned from labelled ones.  Per host a
tree is grown over path segments: digit runs become ``{n}`` and long hexadecimal
runs ``{x}``; below a node with more than ``FAN_OUT`` children, those of ordinary
size become one wildcard; labelled children whose block rate does not differ from
their siblings' (two-proportion z below ``Z``) are merged into one branch.  A
template is rejected if it has ``MIN_LABELS`` labels or more and its purity, the
block rate smoothed towards the host's (itself smoothed towards the corpus'), is
at least ``PURITY``.  Without labelled evidence of its own nothing is blocked.

URLs are folded to (host, generalised path) counts by partial aggregates first,
so a host with a third of all pages is a few rows when the tree is grown; levels
are written to the shared folder one by one.  Paths longer than ``DEPTH`` segments
keep their rest as one last segment.

Edge cases: null URLs and URLs without ``://`` have an empty host and path and are
judged as one more template; repeated rows each get a row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block"))
DEPTH, FAN_OUT, Z, MIN_LABELS, PURITY, STRENGTH = 16, 24, 1.96, 5, 0.8, 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null.  The rules are a short policy list that
    becomes one expression; the first of equally long ones wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules[::-1], key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def generalised(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with numbers and long hexadecimal runs replaced, the rest beyond ``depth`` in one."""
    s = F.regexp_replace(path, "(?<![0-9a-zA-Z])[0-9a-f]{16,}(?![0-9a-zA-Z])", "{x}")
    s = F.filter(F.split(F.regexp_replace(s, "[0-9]+", "{n}"), "/"), lambda x: x != "")
    return F.when(F.size(s) <= depth, s).otherwise(F.concat(F.slice(s, 1, depth - 1), F.array(
        F.array_join(F.slice(s, depth, F.greatest(F.lit(1), F.size(s))), "/"))))


def grow(urls: DataFrame, depth: int = DEPTH, fan_out: int = FAN_OUT, z: float = Z) -> DataFrame:
    """``host``, ``path`` (generalised), ``template`` and counts, from rows of ``host``, ``segments``, ``label``
    (1 block, 0 allow, null none)."""
    t = urls.groupBy("host", F.col("segments").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("l"), F.coalesce(F.sum("label"), F.lit(0)).alias("b"))
    t = materialise(t.withColumn("template", F.col("path")), "url-tree")
    levels = t.agg(F.max(F.size("path"))).first()[0] or 0
    for k in range(min(depth, levels)):
        t_k = t.withColumns({"up": F.slice("template", 1, k), "seg": F.get("template", F.lit(k))})
        child = t_k.where("seg is not null").groupBy("host", "up", "seg").agg(
            *[F.sum(c).alias(c) for c in ("n", "l", "b")])
        up = child.groupBy("host", "up").agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"{c}_all") for c in "nlb"])
        c = child.join(up, ["host", "up"])
        rest_l, rest_b = F.col("l_all") - F.col("l"), F.col("b_all") - F.col("b")
        rate = F.col("b_all") / F.col("l_all")
        spread = F.sqrt(rate * (1 - rate) * (1 / F.col("l") + 1 / rest_l))
        gap = F.abs(F.col("b") / F.col("l") - rest_b / rest_l)
        similar = (F.col("l") > 0) & (rest_l > 0) & (gap <= z * spread)
        variable = (F.col("kids") > fan_out) & (F.col("n") * F.col("kids") <= 2 * F.col("n_all"))
        turn = c.select("host", "up", "seg", F.when(variable, "*").when(similar, "{similar}").alias("as")).where(
            F.col("as").isNotNull())
        new = F.concat("up", F.array("as"), F.slice("template", k + 2, depth + 1))
        t = materialise(t_k.join(turn, ["host", "up", "seg"], "left").select(
            "host", "path", "n", "l", "b", F.when(F.col("as").isNull(), F.col("template")).otherwise(new).alias("template")),
            "url-tree")
    return t


def verdicts(tree: DataFrame, min_labels: int = MIN_LABELS, purity: float = PURITY,
             strength: float = STRENGTH) -> DataFrame:
    """``host``, ``path``, ``template``, ``block_rate``, ``rejected`` of every generalised path."""
    tot = tree.agg(F.sum("l").alias("l"), F.sum("b").alias("b")).first()
    base = (tot["b"] or 0) / (tot["l"] or 1)
    by_host = tree.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    by = tree.groupBy("host", "template").agg(F.sum("l").alias("l"), F.sum("b").alias("b")).join(by_host, "host")
    host_rate = (F.col("hb") + strength * base) / (F.col("hl") + strength)
    smooth = (F.col("b") + strength * host_rate) / (F.col("l") + strength)
    by = by.select("host", "template", smooth.alias("block_rate"),
                   ((F.col("l") >= min_labels) & (smooth >= purity)).alias("rejected"))
    return tree.select("host", "path", "template").join(by, ["host", "template"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url: str = "url",
          label: str | None = None, depth: int = DEPTH, fan_out: int = FAN_OUT, z: float = Z,
          min_labels: int = MIN_LABELS, purity: float = PURITY, strength: float = STRENGTH) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``block_rate``.

    ``label`` names a column of known labels (1 block, 0 allow, null none);
    without it the rules' verdicts are the labels.
    """
    host, path = host_and_path(F.col(url))
    known = F.col(label) if label else F.lit(None).cast("int")
    u = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), known.alias("known"))
    u = u.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), generalised(F.col("path"), depth).alias("segments"))
    named = F.col("known") if label else F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("int"))
    tree = grow(u.select("host", "segments", named.alias("label")), depth, fan_out, z)
    v = verdicts(tree, min_labels, purity, strength).withColumnRenamed("path", "segments")
    return u.join(v, ["host", "segments"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "block_rate")


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
