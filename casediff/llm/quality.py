"""Quality rules with adaptive thresholds (native).

Per document a handful of text statistics is computed with built-in functions.
Fixed cutoffs are replaced by fences taken from mergeable quantile sketches
(Greenwald-Khanna, ``percentile_approx``: partial sketches per task, merged after
the shuffle) for every (language, source), with the language and then the whole
corpus standing in for groups of fewer than ``min_docs`` documents.  The fences
are joined back and decide.

Edge cases: a null text has no words (``base_failed``); a null language or
source is a group of its own; repeated rows are judged one by one; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, materialise, text_or_empty

#: The adaptive measures: name -> (expression over the statistics, slack added to a fence).
#: The slack is the spread that is always allowed, so that a group without any
#: spread does not reject a document for a tiny deviation.
MEASURES = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", 0.1),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", 0.3),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", 0.2),
    "word_length": ("try_divide(word_chars, n_words)", 4.0),
}
TWO_SIDED = ("word_length",)
SPREADS = 6.0
MIN_DOCS = 50
#: Groups (about 150 bytes each) whose fences may be broadcast.
MAX_BROADCAST = 100_000
GRAM = 5
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _covered(starts: Column, width: int) -> Column:
    """Number of positions covered by the windows at the sorted ``starts``."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts, zero,
        lambda acc, s: F.struct((acc["n"] + s + width - F.greatest(s, acc["end"])).alias("n"),
                                (s + width).alias("end")),
        lambda acc: acc["n"])


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source"),
               ) -> DataFrame:
    """``keep`` plus the statistics ``STATS`` of every row, in one pass over the text.

    Repeated windows: the hashes of all five-word windows are compared by
    ``array_distinct``; only a document that has repeats sorts (hash, position)
    pairs, so the cost is linear for clean text and n log n at worst.
    """
    t = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_or_empty(text).alias("t"))
    ks = [f"k{i}" for i in range(len(keep))]
    t = t.select(*ks, "t", blank_words(F.col("t")).alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    t = t.select(
        *ks, "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    grams = F.when(F.size("wh") >= GRAM, F.transform(
        F.sequence(F.lit(1), F.size("wh") - (GRAM - 1)),
        lambda i: F.xxhash64(F.slice("wh", i, GRAM)))).otherwise(F.array().cast("array<bigint>"))
    t = t.select(*ks, *[c for c in STATS if c != "n_repeat_words"], grams.alias("g"))
    ranked = F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(
        F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    t = t.select(*ks, *[c for c in STATS if c != "n_repeat_words"], ranked.alias("r"))
    repeated = F.filter("r", lambda x, j: (
        (F.get(F.col("r"), j + 1)["h"] == x["h"]) | (F.get(F.col("r"), j - 1)["h"] == x["h"])))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    return t.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        *[c for c in STATS if c != "n_repeat_words"],
        F.when(F.col("r").isNull(), F.lit(0)).otherwise(_covered(starts, GRAM)).cast("long")
        .alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or over a fifth of them in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fences(stats: DataFrame, lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with a lower and an upper fence per measure.

    Documents that fail the base rules are left out of the sketches.  A fence is
    the upper (lower) quartile plus (minus) ``SPREADS`` times its distance from
    the median, plus (minus) the slack.
    """
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    base = stats.where(~base_failed()).select(
        F.struct(F.col(lang).alias("v")).alias("l"), F.struct(F.col(source).alias("v")).alias("s"),
        *[F.expr(e).alias(m) for m, (e, _) in MEASURES.items()])
    sketch = base.rollup("l", "s").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, probs, 10000).alias(m) for m in MEASURES])

    def cut(m: str, up: bool) -> Column:
        q, slack = F.col(m), MEASURES[m][1]
        if up:
            return q[2] + SPREADS * (q[2] - q[1]) + slack
        return q[0] - SPREADS * (q[1] - q[0]) - slack

    sketch = sketch.select("l", "s", "n", F.struct(
        *[cut(m, True).alias(f"{m}_hi") for m in MEASURES],
        *[cut(m, False).alias(f"{m}_lo") for m in TWO_SIDED]).alias("f"))
    group = sketch.where(F.col("l").isNotNull() & F.col("s").isNotNull())
    by_lang = sketch.where(F.col("l").isNotNull() & F.col("s").isNull()).select(
        "l", F.col("n").alias("ln"), F.col("f").alias("lf"))
    whole = sketch.where(F.col("l").isNull()).select(F.col("f").alias("wf"))
    # every (lang, source) of the rows, also one whose documents all fail the base rules
    keys = stats.select(F.struct(F.col(lang).alias("v")).alias("l"),
                        F.struct(F.col(source).alias("v")).alias("s")).distinct()
    found = (keys.join(group, ["l", "s"], "left").join(by_lang, "l", "left")
             .join(F.broadcast(whole), F.lit(True), "left"))  # one row: the whole corpus
    chosen = (F.when(F.col("n") >= min_docs, F.col("f")).when(F.col("ln") >= min_docs, F.col("lf"))
              .otherwise(F.col("wf")))
    return found.select("l", "s", chosen.alias("fence"))


def judge(stats: DataFrame, fence: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` plus ``base_failed`` and ``kept``: joined with the group's fences."""
    j = stats.withColumns({
        "__l": F.struct(F.col(lang).alias("v")), "__s": F.struct(F.col(source).alias("v"))})
    fence = materialise(fence.withColumnsRenamed({"l": "__l", "s": "__s"}), "quality-fences")
    if fence.count() <= MAX_BROADCAST:  # else the join is dealt out by key, and AQE splits a hot group
        fence = F.broadcast(fence)
    j = j.join(fence, ["__l", "__s"], "left")
    bad = F.lit(False)
    for m, (e, _) in MEASURES.items():
        bad = bad | F.coalesce(F.expr(e) > F.col(f"fence.{m}_hi"), F.lit(False))
        if m in TWO_SIDED:
            bad = bad | F.coalesce(F.expr(e) < F.col(f"fence.{m}_lo"), F.lit(False))
    return (j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)
            .drop("__l", "__s", "fence"))


def quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang",
            source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: id, statistics, ``base_failed``, ``kept``."""
    stats = materialise(statistics(docs, text, (id_col, lang, source)), "quality-stats")
    return judge(stats, fences(stats, lang, source, min_docs), lang, source)


def keep_good(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs`` (``text``, ``lang``, ``source``) that are kept, unchanged."""
    cols = docs.columns
    small = materialise(statistics(docs, "text", ("lang", "source")), "quality-stats")
    whole = docs.select(F.struct(*cols).alias("row"), "text", "lang", "source")
    judged = judge(statistics(whole, "text", ("row", "lang", "source")), fences(small, min_docs=min_docs))
    # as an array's element the verdict stays one condition on the joined row: taken apart, its parts
    # would be moved below the projections and computed anew for every reference
    return judged.where(F.exists(F.array("kept"), lambda k: k)).select("row.*")


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_ratio(e: str) -> str:
    a, b = e.removeprefix("try_divide(").removesuffix(")").split(", ")
    return f"{a}::DOUBLE / nullif({b}, 0)"


def _sql_fence(m: str) -> str:
    e, slack = MEASURES[m]
    hi = f"q_{m}[3] + {SPREADS} * (q_{m}[3] - q_{m}[2]) + {slack} AS {m}_hi"
    return hi + (f", q_{m}[1] - {SPREADS} * (q_{m}[2] - q_{m}[1]) - {slack} AS {m}_lo" if m in TWO_SIDED else "")


def _sql_level(keys: str, name: str) -> str:
    qs = ", ".join(f"quantile_disc({_sql_ratio(e)}, [0.25, 0.5, 0.75]) AS q_{m}"
                   for m, (e, _) in MEASURES.items())
    sel = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (f"{name} AS (SELECT {sel}n, {', '.join(map(_sql_fence, MEASURES))} FROM "
            f"(SELECT {sel}count(*) AS n, {qs} FROM b WHERE NOT base_failed {group}))")


def _sql_bad() -> str:
    tests = []
    for m, (e, _) in MEASURES.items():
        x = _sql_ratio(e)

        def pick(side: str, m: str = m) -> str:
            return (f"CASE WHEN g.n >= {MIN_DOCS} THEN g.{m}_{side} WHEN l.n >= {MIN_DOCS} THEN l.{m}_{side} "
                    f"ELSE w.{m}_{side} END")
        tests.append(f"coalesce({x} > {pick('hi')}, false)")
        if m in TWO_SIDED:
            tests.append(f"coalesce({x} < {pick('lo')}, false)")
    return " OR ".join(tests)


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
gd AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT i + j) AS n FROM gd, range(0, 5) t(j) GROUP BY rid),
s AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rw USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
{_sql_level("lang, source", "gs")}, {_sql_level("lang", "lv")}, {_sql_level("", "wv")}
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_sql_bad()}) AS kept
FROM b LEFT JOIN gs g ON g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source
LEFT JOIN lv l ON l.lang IS NOT DISTINCT FROM b.lang CROSS JOIN wv w"""
