"""Secret scans: base patterns plus character Markov models (native).

Base patterns are found leftmost and without overlap by Java regular
expressions; spans are in code points.  Beyond them, long tokens are scored by
two first-order character models, one of random strings and one of ordinary
identifiers, and a token whose log-likelihood ratio per transition is over
the model's cut-off is a span of kind ``markov`` unless it touches a base span.

Training: the values of the base spans in a bounded sample of documents
(``train_docs``) are the labelled random strings, together with their SHA-256 in
upper-case hex and Base64 so that the model knows those alphabets too; the
words of the same documents outside base spans are the ordinary identifiers, each
also joined to itself as identifiers are (by a sign, a capital, a number, in upper
case), so that such transitions count as ordinary.  A quarter of the labelled
values is held out: the cut-off is ``CUT_SHARE`` of the ratio that all but ``CUT_MISSED`` of 20-character
Base64 strings hashed from them reach, and ``MIN_RATIO`` at least.  The transition table has at most 2 x 65 x 65 cells and is all that reaches the
driver.  Scoring covers every whole text.

Positions come from splitting a text at the matches: the lengths of the pieces
are summed up in two levels, so a text with many matches stays cheap.

Edge cases: null and empty texts have no spans; repeated rows each get the
result; without any labelled secret the random model is uniform; an empty table
gives an empty result; clashing extra columns are not touched.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Equal to the runs of the class that are long enough: greedy runs are maximal, so one starts where none goes on.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
#: Tokens the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Ordinary identifiers for training: whole tokens without digits, so that unlabelled secrets stay out.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z_-]{4,}(?![A-Za-z0-9+/_=-])"
#: An ``ASSIGN`` match has one of these in its lower-cased text; a search for them is many times cheaper.
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
#: Least cut-off; share of the held-out strings' low ratio that is the cut-off, and how many of them lie below that ratio.
MIN_RATIO, CUT_SHARE, CUT_MISSED = 1.5, 0.75, 0.02
TRAIN_DOCS = 5_000
ALPHABET = 65
STEP = 64
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _before(lens: Column, i: Column, blocks: Column) -> Column:
    """Sum of the first ``i`` entries of ``lens``, from the sums of its blocks."""
    b = F.floor(i / STEP).cast("int")
    part = F.aggregate(F.slice(lens, b * STEP + 1, i - b * STEP), F.lit(0), lambda a, x: a + x)
    return F.get(blocks, b) + part


def _block_sums(lens: Column) -> Column:
    """Sum of ``lens`` before each block of ``STEP`` entries."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / STEP).cast("int")), lambda b: F.aggregate(
        F.slice(lens, b * STEP + 1, STEP), F.lit(0), lambda a, x: a + x))
    return F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.get(a, F.size(a) - 1) + x)))


def _found(text: str, pattern: str, groups: tuple[int, ...], keys: tuple[str, ...] = ()) -> Column:
    """Null without a match, else the pieces' lengths, the matches and the given groups of the matches.
    With ``keys``, the pattern is tried only where the lower-cased text has one of them."""
    p = F.lit(pattern)
    has = F.col(text).rlike(pattern)
    if keys:
        has = F.exists(F.array(F.lower(text)), lambda t: reduce(or_, [t.contains(k) for k in keys])) & has
    return F.when(has, F.struct(
        F.transform(F.split(F.col(text), pattern), F.length).alias("pieces"),
        *[F.regexp_extract_all(F.col(text), p, F.lit(g)).alias(f"g{g}") for g in groups]))


def _lens(found: str) -> Column:
    """Lengths of piece, match, piece, match, ... in one array."""
    return F.flatten(F.zip_with(f"{found}.pieces", f"{found}.g0", lambda a, b: F.array(
        F.coalesce(a, F.lit(0)), F.coalesce(F.length(b), F.lit(0)))))


def _spans(found: str, lens: str, kind: int, ok) -> Column:
    sums = f"{lens}_sums"
    at = F.transform(f"{found}.g0", lambda m, i: F.struct(
        _before(F.col(lens), 2 * i + 1, F.col(sums)).alias("start"), F.lit(kind).alias("kind"),
        _before(F.col(lens), 2 * i + 2, F.col(sums)).alias("end"), ok(m, i).alias("ok")))
    kept = F.transform(F.filter(at, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.coalesce(kept.cast(SPAN), F.array().cast(SPAN))


def _code(c: Column) -> Column:
    """Symbol number of a character: 0-9, A-Z, a-z, then the five others as 62, 63, 64."""
    a = F.ascii(c)
    return (F.when(a.between(48, 57), a - 48).when(a.between(65, 90), a - 55).when(a.between(97, 122), a - 61)
            .when(c.isin("+", "-"), 62).when(c.isin("/", "_"), 63).otherwise(64))


def _cells(token: Column) -> Column:
    """The transition cells of a token, in order."""
    codes = F.transform(F.split(token, ""), _code)
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1),
                      lambda a, b: a * ALPHABET + b)


class Model(NamedTuple):
    """Log-likelihood ratio (random over ordinary) of every transition cell, and the cut-off per transition."""

    ratios: list[float]
    cut: float


def _ratio(token: Column, ratios: Column) -> Column:
    """Mean ratio of a token's transitions."""
    cells = _cells(token)
    return F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.get(ratios, c)) / F.size(cells)


def train(docs: DataFrame, text: str = "text", train_docs: int = TRAIN_DOCS, id_col: str = "doc_id") -> Model:
    """The models of a bounded sample.

    The sample takes rows by the hash of their id and text, about ``train_docs``
    of them (all where there are no more); every cell counts once more than seen.
    """
    t = docs.select(F.col(id_col).alias("i"), text_or_empty(text).alias("t"))
    n = t.count()
    if n > train_docs:
        t = t.where(F.pmod(F.xxhash64("i", "t"), F.lit(2**40)) < int(2**40 * train_docs / n))
    t = t.select("t")
    value = F.explode(F.flatten(F.array(
        F.filter(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12),
        F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))))
    values = t.select(value.alias("v")).distinct()
    held = F.pmod(F.xxhash64("v"), F.lit(4)) == 0
    unseen, values = values.where(held), values.where(~held)
    values = values.select(F.explode(F.array(
        "v", F.upper(F.sha2("v", 256)), F.base64(F.unhex(F.sha2("v", 256))))).alias("v"))
    rest = F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), HEX, " ")
    words = t.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("v"))
    # identifiers join words by a sign or a capital, and may end in a number: these transitions are ordinary too
    w = F.col("v")
    words = words.select(F.explode(F.array(
        w, F.concat(w, F.lit("_"), w), F.concat(w, F.lit("-"), w), F.concat(w, F.lit("/"), w), F.concat(w, F.initcap(w)),
        F.upper(F.concat(w, F.lit("_"), w)), F.concat(w, (F.length(w) % 10).cast("string"), F.lit("_"), w))).alias("v"))
    tokens = (values.select(F.lit(1).alias("random"), "v").unionAll(words.select(F.lit(0).alias("random"), "v"))
              .where(F.length("v") >= 2).groupBy("random", "v").agg(F.count(F.lit(1)).alias("n")))
    cells = tokens.select("random", "n", F.explode(_cells(F.col("v"))).alias("cell"))
    counts: dict[tuple[int, int], int] = {
        (r["random"], r["cell"]): r["n"] for r in cells.groupBy("random", "cell").agg(F.sum("n").alias("n")).collect()}
    rows = {(k, a): sum(counts.get((k, a * ALPHABET + b), 0) for b in range(ALPHABET))
            for k in (0, 1) for a in range(ALPHABET)}

    def log_p(k: int, cell: int) -> float:
        return math.log((counts.get((k, cell), 0) + 1) / (rows[k, cell // ALPHABET] + ALPHABET))

    ratios = [log_p(1, c) - log_p(0, c) for c in range(ALPHABET * ALPHABET)]
    # a few dozen strings of each held-out value, for a low quantile of few would be their least
    unseen = unseen.select("v", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("i"))
    token = F.substring(F.base64(F.unhex(F.sha2(F.concat("v", F.col("i").cast("string")), 256))), 1, 20)
    low = unseen.select(_ratio(token, F.lit(ratios)).alias("r")).agg(F.percentile_approx("r", CUT_MISSED, 10_000)).first()[0]
    return Model(ratios, max(MIN_RATIO, CUT_SHARE * low) if low is not None else MIN_RATIO)


def scan(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, the text ``t`` and its ``spans``: (start, kind number, end) sorted by start, then kind."""
    ks = [f"k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(k) for k, c in zip(ks, keep, strict=True)], text_or_empty(text).alias("t"))
    d = d.select(*ks, "t", _found("t", ASSIGN, (0, 2), KEYS).alias("fa"), _found("t", ACCESS, (0,)).alias("fc"),
                 _found("t", HEX, (0,)).alias("fh"), _found("t", TOKEN, (0,)).alias("fm"))
    d = d.select("*", *[_lens(f"f{x}").alias(f"l{x}") for x in "achm"])
    d = d.select("*", *[_block_sums(F.col(f"l{x}")).alias(f"l{x}_sums") for x in "achm"])
    always = lambda m, i: F.lit(True)
    ratios = F.lit(model.ratios)

    def random_like(m: Column, i: Column) -> Column:
        return _ratio(m, ratios) > model.cut

    d = d.select(*ks, "t", F.concat(
        _spans("fa", "la", 0, lambda m, i: F.length(F.get(F.col("fa.g2"), i)) >= 12),
        _spans("fc", "lc", 1, always), _spans("fh", "lh", 2, always)).alias("base"),
        _spans("fm", "lm", 3, random_like).alias("more"))
    extra = F.when(F.size("more") > 0, F.filter("more", lambda m: ~F.exists(
        F.col("base"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))).otherwise(F.col("more"))
    return d.select(*[F.col(k).alias(c) for k, c in zip(ks, keep, strict=True)], "t",
                    F.sort_array(F.concat("base", extra)).alias("spans"))


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
                 train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Train on ``docs`` and scan them."""
    return scan(docs, train(docs, text, train_docs), keep, text)


def redact(docs: DataFrame, mark: str = "[SECRET]", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one mark) and, where
    there is such a column, ``n_chars`` brought up to date in the changed rows; other rows unchanged."""
    cols = docs.columns
    s = scan(docs.select(F.struct(*cols).alias("row"), "text"), train(docs, "text", train_docs), ("row",))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    fold = F.aggregate("spans", zero, lambda a, x: F.struct(
        F.when(x["start"] < a["end"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(F.col("t"), a["end"] + 1, x["start"] - a["end"]), F.lit(mark))).alias("out"),
        F.greatest(a["end"], x["end"]).alias("end")),
        lambda a: F.concat(a["out"], F.substring(F.col("t"), a["end"] + 1, F.length("t"))))
    s = s.withColumn("clean", F.when(F.size("spans") > 0, fold))
    out = []
    for c in cols:
        if c == "text":
            out.append(F.coalesce(F.col("clean"), F.col("row.text")).alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.col("clean").isNotNull(), F.length("clean").cast(kind)).otherwise(
                F.col("row.n_chars")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return s.select(*out)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10(spark, sf_dir: str) -> DataFrame:
    s = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return s.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                    F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
