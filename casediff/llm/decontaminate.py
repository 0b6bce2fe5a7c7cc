"""Benchmark decontamination against normalised test n-grams (native).

Benchmark items are cut into windows of ``width`` normalised words (a shorter
item is one window).  The distinct windows form a broadcast hash set; every
training document hashes all its windows in place, the hashes are probed, and a
hit counts only after its words were compared with the benchmark window's.

The set is broadcast only after its rows and bytes were counted (``max_broadcast``,
``MAX_BROADCAST_BYTES``).
Beyond that the windows' hashes are shuffled to it instead, without the words,
and the hits are joined back to the texts to be compared.

Everything is a function of the text, so hits are gathered per text digest: a
group of equal copies folds together before the shuffle, and repeated rows each
get the result.  Null and empty texts have no words and no hits; null or empty
items have no windows; an item id that occurs twice counts once; other columns
are not looked at.  A very long text is cut into
short runs of words that go through one by one.  Without items, or without any word in
them, no document is hit; an empty table of documents gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest128, table, text_or_empty

WIDTH = 10
#: Distinct benchmark windows that may be broadcast (about 200 bytes each), and their bytes, for words and
#: lists of items can be long.
MAX_BROADCAST, MAX_BROADCAST_BYTES = 1_000_000, 256 << 20
#: Window starts in one run of words.
BLOCK = 32
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased: runs of ASCII letters, digits and non-ASCII characters.

    ``lower`` agrees with that rule for texts in ASCII alone and is much faster
    than ``translate``, which the others take."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def _blocks(width: int) -> Column:
    """Runs of ``BLOCK`` window starts of the words ``w``: (1-based first start, the words its windows cover).

    Windows are exploded from these short runs, so that a window's row carries a
    few dozen words to be compared with and never the document's whole array."""
    starts = F.sequence(F.lit(1), F.size("w"), F.lit(BLOCK))
    return F.when(F.size("w") > 0, F.transform(starts, lambda i: F.struct(
        i.alias("at"), F.slice("w", i, BLOCK + width - 1).alias("bw")))).otherwise(
        F.array().cast("array<struct<at:int,bw:array<string>>>"))


def _probes(width: int) -> Column:
    """(hash, length, 1-based place) of the block's windows of ``width`` words, from the word hashes ``wh``."""
    n = F.least(F.lit(BLOCK), F.size("wh") - (width - 1))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.xxhash64(*[F.get(F.col("wh"), i + (k - 1)) for k in range(width)]).alias("h"),
        F.lit(width).alias("len"), i.alias("j")))).otherwise(
        F.array().cast("array<struct<h:bigint,len:int,j:int>>"))


def test_grams(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct benchmark window: ``h``, ``len``, ``gram`` (words), ``items`` (ids as strings)."""
    w = items.select(F.col(item_id).cast("string").alias("item"), normal_words(text_or_empty(text)).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    w = w.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("len")))).alias("gram"))
    return (w.groupBy("len", "gram").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("h"), "len", "gram", "items"))


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, max_broadcast: int = MAX_BROADCAST,
         text: str = "text") -> DataFrame:
    """Verified hits: ``digest`` of the text, 1-based ``pos``, ``len``, ``items``."""
    grams = test_grams(items, width)
    size = (F.octet_length(F.array_join("gram", "")) + F.octet_length(F.array_join("items", ""))
            + 16 * (F.size("gram") + F.size("items")) + 64)
    sizes = grams.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("bytes")).collect()
    d = docs.select(text_or_empty(text).alias("t"))
    d = d.select(digest128(F.col("t")).alias("digest"), normal_words(F.col("t")).alias("w"))
    b = d.select("digest", F.inline(_blocks(width)))
    b = b.select("digest", "at", "bw", F.transform("bw", lambda x: F.xxhash64(x)).alias("wh"))
    # at most ``width`` lengths: the full one and those of shorter items
    probes = [_probes(n) for n in sorted(r["len"] for r in sizes)]
    probes = F.concat(*probes) if probes else F.array().cast("array<struct<h:bigint,len:int,j:int>>")
    pos = (F.col("at") + F.col("j") - 1).alias("pos")
    if sum(r["n"] for r in sizes) <= max_broadcast and sum(r["bytes"] for r in sizes) <= MAX_BROADCAST_BYTES:
        return (b.select("digest", "at", "bw", F.inline(probes)).join(F.broadcast(grams), ["h", "len"])
                .where(F.expr("slice(bw, j, len) = gram")).select("digest", pos, "len", "items"))
    probed = b.select("digest", "at", F.inline(probes)).select("digest", pos, "h", "len").join(grams, ["h", "len"])
    return (probed.join(d.dropDuplicates(["digest"]), "digest").where(F.expr("slice(w, pos, len) = gram"))
            .select("digest", "pos", "len", "items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                  max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per text with a hit: ``digest``, ``spans`` (sorted (pos, len)), ``n_hit`` words, ``items`` (sorted)."""
    found = hits(docs, items, width, max_broadcast).groupBy("digest").agg(
        F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(s["pos"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["pos"] + s["len"]).alias("end")), lambda a: a["n"])
    return found.select("digest", "spans", n_hit.cast("long").alias("n_hit"), "items")


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", width: int = WIDTH,
           max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``contaminated``."""
    d = docs.select(F.col(id_col).alias("id"), text_or_empty().alias("t"))
    d = d.select("id", F.size(normal_words(F.col("t"))).cast("long").alias("n_words"),
                 digest128(F.col("t")).alias("digest"))
    r = d.join(contamination(docs, items, width, max_broadcast), "digest", "left")
    return r.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                      max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs`` without any hit, unchanged."""
    bad = contamination(docs, items, width, max_broadcast).select(F.col("digest").alias("__digest"))
    return docs.withColumn("__digest", digest128(text_or_empty())).join(bad, "__digest", "left_anti").drop("__digest")


def remove_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH,
                 max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``docs`` with the text of contaminated rows reduced to their words (as normalised) outside all hits,
    joined by one space; other rows unchanged."""
    bad = contamination(docs, items, width, max_broadcast).select(
        F.col("digest").alias("__digest"), F.col("spans").alias("__spans"))
    j = docs.withColumn("__digest", digest128(text_or_empty())).join(bad, "__digest", "left")
    hit = F.array_distinct(F.flatten(F.transform(
        "__spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))
    # the words are a column of their own: inside the function of an array element they would be split anew
    j = j.withColumn("__w", F.when(F.col("__spans").isNotNull(), normal_words(text_or_empty())))
    j = j.withColumn("__left", F.array_except(F.sequence(F.lit(1), F.size("__w")), hit))
    clean = F.array_join(F.transform("__left", lambda i: F.get(F.col("__w"), i - 1)), " ")
    return j.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)).drop(
        "__digest", "__spans", "__w", "__left")


def op7(spark, sf_dir: str) -> DataFrame:
    r = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(
        translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(
        translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
        SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM (SELECT *, least(len(w), {WIDTH}) AS l FROM b WHERE len(w) > 0))),
p AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
        SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
h AS (SELECT rid, i, l, item FROM p JOIN g USING (g, l)),
n AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM h, range(0, {WIDTH}) t(j) WHERE j < l GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
      FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""
