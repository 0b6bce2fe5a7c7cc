"""Near-duplicate classes with ProbMinHash signatures, banding and verification.

Similarity: Jaccard of the sets of five-word shingles (A-Z as a-z, words between
blanks; a shorter text is one shingle), linked at ``threshold`` or more.

Signatures: each distinct shingle, weighted by 1 + ln(count), sends a Poisson
process of arrivals, at a rate equal to its weight, to random places of the
signature; a place keeps the shingle that came first, so two signatures agree at
a place with the probability Jaccard similarity of the weighted sets.  A process
stops as soon as its clock has passed the latest first arrival of all places.
Links are defined on the sets without weights, and shingles that repeat inside a
text can push the weighted similarity far below; so a text with a repeated shingle
has a second signature with all weights 1.  Without repeats both are the same.

Candidates: texts that agree on all rows of a band.  All equal texts are one
node from the start.  In each bucket every node is compared with one hub, the
node that meets most others over all its bands, and the verified links give
components.  Where a bucket then still holds several components, all its nodes
are compared across components in the hub's group, exactly and in tiles of two
bounded blocks: a tile multiplies incidence matrices and gives back the links
that join components, never the pairs.  Blocks of one large component are not
compared with each other, so a group of thousands of copies costs a star and the
few nodes around it, and no link between texts that met in a band is lost.

By the weights of 1 alone, which any two texts have in common, the banding misses a
link at exactly 0.8 with probability (1 - 0.8^4)^32 = 5e-8, and a closer one less often.

Edge cases: null and empty texts have no shingles and are near nothing, but equal
texts (also empty ones; null counts as empty) share a class; null ids come last
when a class is named; repeated rows each get a row; a very long text is read whole, by
one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest128, materialise, table, text_or_empty
from .wordhash import mix, run_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: Nodes and shingles in a block of a tile, and shingles multiplied at a time.
BLOCK_NODES, BLOCK_ITEMS, COLUMNS = 512, 1_000_000, 4096
LAST = 2**63 - 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text, and their counts."""
    words = word_hashes(text, lower=True)
    return np.unique(run_hashes(words, max(1, min(width, len(words)))), return_counts=True)


def signature(items: np.ndarray, weights: np.ndarray, places: int) -> np.ndarray:
    """The item that arrives first at each place (``places``: a power of two)."""
    first = np.full(places, np.inf)
    who = np.zeros(places, dtype=np.uint64)
    clock = np.zeros(len(items))
    turn = 0
    expected = int(places * (np.log(places) + 1))  # arrivals until every place has one
    while len(items):
        k = max(1, expected // len(items)) if turn == 0 else max(1, places // len(items))
        turns = np.arange(turn + 1, turn + k + 1, dtype=np.uint64) * _GOLD
        bits = mix(items[:, None] + turns[None, :])
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
        when = clock[:, None] + np.cumsum(gaps, axis=1) / weights[:, None]
        place = (bits & np.uint64(places - 1)).astype(np.int64)
        flat, at = when.ravel(), place.ravel()
        np.minimum.at(first, at, flat)
        won = np.flatnonzero(flat == first[at])
        who[at[won]] = items[won // k]
        clock, turn = when[:, -1], turn + k
        go = clock < first.max()
        items, weights, clock = items[go], weights[go], clock[go]
    return who


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
    for column in sig.reshape(bands, rows).T:
        h = mix(h ^ column) + _GOLD
    return h.view(np.int64)


def text_bands(items: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bands of the weighted signature, and of the unweighted one where a shingle repeats (else they are the same)."""
    if not len(items):
        return np.empty(0, dtype=np.int64)
    found = band_hashes(signature(items, 1 + np.log(counts), bands * rows), bands, rows)
    if counts.max() == 1:
        return found
    plain = band_hashes(signature(items, np.ones(len(items)), bands * rows), bands, rows)
    return np.unique(np.concatenate([found, plain]))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("ord"),
                    text_or_empty(text).alias("t"))
    return d.withColumn("digest", digest128(F.col("t")))


def _nodes(texts: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """One row per distinct text: ``node``, ``digest``, ``owner`` (smallest id), ``size``, ``bands``."""

    def sign(batches):
        for b in batches:
            size, found = [], []
            for t in b.column(2):
                items, counts = shingles(t.as_buffer(), width)
                size.append(len(items))
                found.append(text_bands(items, counts, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                names=["digest", "ord", "size", "bands"])

    signed = texts.select("digest", "ord", "t").mapInArrow(
        sign, "digest binary, ord bigint, size int, bands array<bigint>")
    # the written table fixes the node numbers
    return materialise(signed.groupBy("digest").agg(
        F.min("ord").alias("owner"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "near-nodes")


def _pair_sizes(threshold: float):
    """Sets whose sizes differ by more cannot be similar enough."""
    return F.least("size", "size2") >= threshold * F.greatest("size", "size2")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok.append(both >= threshold * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def components(links: DataFrame, name: str = "near-links") -> DataFrame:
    """``node`` and ``label`` (smallest node of its component) of every linked node.

    Alternating large-star and small-star rounds; each is a grouped minimum
    joined back, written to the shared folder, until the links stay the same.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            e = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = e.join(low, "a")
        if large:
            out = e.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = e.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                low.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = mark(edges)
    while True:
        edges = materialise(star(star(edges, True), False), name)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _sets(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node`` and its sorted shingle hashes, for the wanted nodes."""

    def find(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shingles(t.as_buffer(), width)[0].tobytes() for t in b.column(1)], pa.binary())],
                names=["node", "items"])

    n = nodes.join(wanted, "node").select(F.col("digest").alias("d"), "owner", "node")
    return texts.join(n, (texts.digest == n.d) & (texts.ord == n.owner)).dropDuplicates(["node"]).select(
        "node", "t").mapInArrow(find, "node bigint, items binary")


def _tile(width: int, threshold: float):
    """Compare the nodes of one or two blocks across labels; a forest of the links that join labels."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        own = (pdf["block"] == pdf["first"]).to_numpy()
        items = [np.frombuffer(x, dtype=np.uint64) for x in pdf["items"]]
        size = np.array([len(x) for x in items], dtype=np.float32)
        row = np.repeat(np.arange(len(items)), size.astype(np.int64))
        _, code, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = count[code] > 1
        number = np.cumsum(count > 1) - 1
        row, code = row[shared], number[code[shared]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        left = np.flatnonzero(own)
        right = np.flatnonzero(~own) if not own.all() else left
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            lo, hi = np.searchsorted(code, [at, at + COLUMNS])
            part = np.zeros((len(items), COLUMNS), dtype=np.float32)
            part[row[lo:hi], code[lo:hi] - at] = 1
            both += part[left] @ part[right].T
        near = both >= threshold * (size[left][:, None] + size[right][None, :] - both)
        near &= label[left][:, None] != label[right][None, :]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        out = []
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = root(int(label[left[i]])), root(int(label[right[j]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(node[left[i]]), int(node[right[j]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def _across(met: DataFrame, label: DataFrame, sets: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links between components that share a bucket, from exact comparisons within the groups of the hubs."""
    m = met.join(label, "node", "left").select("band", "hub", "node", "size", F.coalesce("label", "node").alias("label"))
    mixed = m.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("band")
    m = materialise(m.join(mixed, "band").select("hub", "node", "size", "label").distinct(), "near-mixed")
    # blocks: a large component has blocks of its own, the small ones of a hub share some by their hash
    big = m.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).select(
        "hub", "label", F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.col("s") / BLOCK_ITEMS)).alias("own")).where("own > 1")
    m = m.join(big, ["hub", "label"], "left")
    small = m.where("own is null").groupBy("hub").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK_NODES, F.sum("size") / BLOCK_ITEMS)).alias("some"))
    m = m.join(small, "hub", "left").select("hub", "node", "label", F.when(
        F.col("own").isNull(), F.struct(F.lit(-1).cast("bigint").alias("of"), F.pmod(
            F.xxhash64("label"), "some").cast("bigint").alias("k"))).otherwise(
        F.struct(F.col("label").alias("of"), F.pmod(F.xxhash64("node"), "own").cast("bigint").alias("k"))).alias("block"))
    m = materialise(m, "near-blocks")
    blocks = m.select("hub", "block").distinct()
    tiles = blocks.select("hub", F.col("block").alias("first")).join(
        blocks.select("hub", F.col("block").alias("second")), "hub").where(
        "first <= second and (first.of != second.of or first.of = -1)")
    ends = tiles.select("hub", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    rows = m.join(ends, ["hub", "block"]).join(sets, "node")
    return rows.groupBy("hub", "first", "second").applyInPandas(_tile(width, threshold), "a bigint, b bigint")


def near_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE,
               threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (``node``, ``digest``, ``owner``) and the ``label`` of every linked node."""
    texts = _texts(docs, id_col, text)
    nodes = _nodes(texts, width, bands, rows)
    member = nodes.select("node", "size", F.explode("bands").alias("band"))
    full = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(member.join(full, "band"), "near-members")  # members of buckets with more than one
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    best = met.join(weight, "node").groupBy("band").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("minus"), "size")).alias("best"))
    met = materialise(met.join(best.select("band", (-F.col("best.minus")).alias("hub"), F.col("best.size").alias("size2")),
                               "band"), "near-hubs")
    star = materialise(met.where("node != hub").where(_pair_sizes(threshold)).select(
        F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "near-pairs")
    sets = materialise(_sets(texts, nodes, met.select("node").distinct(), width), "near-sets")
    links = materialise(verify(star, sets, threshold), "near-verified")
    label = materialise(components(links), "near-labels")
    more = materialise(_across(met, label, sets, width, threshold), "near-across")
    joined = more.unionAll(label.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    return nodes.select("node", "digest", "owner"), materialise(components(joined), "near-labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE,
                 threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per distinct text: ``digest``, ``owner``, ``class_id`` (smallest id in its class)."""
    nodes, label = near_links(docs, id_col, text, width, threshold, bands, rows)
    n = nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = n.groupBy("label").agg(F.min(F.struct("owner", "digest")).alias("best"))
    return materialise(n.join(best, "label").select(
        "digest", "owner", F.col("best.owner").alias("class_id"), F.col("best.digest").alias("class_digest")),
        "near-classes")


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: id and ``class_id`` (null in a class of null ids alone)."""
    c = near_classes(docs, id_col, text, **how).select("digest", "class_id")
    d = docs.select(F.col(id_col).alias("id"), digest128(text_or_empty(text)).alias("digest"))
    return d.join(c, "digest").select(
        F.col("id").alias(id_col), F.when(F.col("class_id") != LAST, F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Of each class the document with the smallest id, unchanged (of rows equal in id and text, one)."""
    c = near_classes(docs, id_col, "text", **how).where("digest = class_digest").select(
        F.col("digest").alias("__digest"), F.col("owner").alias("__ord"))
    d = docs.withColumns({"__digest": digest128(text_or_empty()),
                          "__ord": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST))})
    return d.join(c, ["__digest", "__ord"]).dropDuplicates(["__digest", "__ord"]).drop("__digest", "__ord")


def op8(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
