"""Exact removal of repeated word runs with prefix-partitioned suffix trees.

Every window of ``width`` words that also starts earlier (in a document with a
smaller id, or earlier in the same one) is repeated; the words it covers go.

The trees are sparse: of the suffixes of a text they hold those that start at an
anchor, the run of ``ANCHOR`` words with the smallest hash inside some window.  Equal
windows have their anchors at equal places, so no repeat of ``width`` words is lost,
and a suffix travels with the words of its windows only.

* The first ``ANCHOR`` words of a suffix are its prefix; suffixes with one prefix
  form one subtree.  A counted pass drops prefixes that occur once (such suffixes are
  unique) and splits prefixes with more than ``GROUP`` suffixes over salted parts, so
  that a part always fits in memory; the nodes as deep as a whole window, the longest
  prefixes, are then merged over the parts by a native aggregate of their first leaves.
* In a task the suffixes of its subtrees are sorted by their words, and neighbours'
  common lengths give the nodes: the leaves below a node of depth d are a run of
  suffixes that share d words.  The words before the anchors are sorted the same way,
  backwards.  Suffixes that share ``width - o`` words and have the same ``o`` words
  before them lie in one window of ``width`` words: all leaves of such a node but the
  first are repeats.
* ``maximal_repeats`` joins the windows that follow each other in both places, so
  that every repeat is as long as it gets.

Words are compared by hashes of 64 bits, merged nodes by hashes of 128 bits.  Each
step is written to the shared folder before the next.

Edge cases: null and empty texts have no words; null ids come after all others;
rows with equal id and text are one document and get the same result; equal ids
with different texts are ordered by the texts' digests; of exact copies with
other ids only the one with the smallest id is kept (if it has a window); a
very long text is hashed in pieces and all of its windows count; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest128, materialise, table, text_or_empty
from .wordhash import mix, run_hashes, word_hashes

WIDTH, ANCHOR = 20, 8
#: Suffixes with one prefix that are sorted in one part.
GROUP = 8_000
LAST = 2**63 - 1


def anchors(words: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of each anchor of a text, by place.

    A window's anchor is the leftmost smallest run hash in it, so places never
    go back and the windows of one place are neighbours."""
    runs = run_hashes(words, anchor)
    n = len(words) - width + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none, none
    view = np.lib.stride_tricks.sliding_window_view(runs, width - anchor + 1)
    step = 1 << 16  # windows looked at together
    place = np.concatenate([view[i:i + step].argmin(axis=1) + np.arange(i, min(i + step, n)) for i in range(0, n, step)])
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return runs[place[first]], place[first], first, np.diff(first, append=n)


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("ord"),
                    text_or_empty(text).alias("t"))
    return d.withColumn("digest", digest128(F.col("t")))


def _with_anchors(texts: DataFrame, width: int, anchor: int) -> DataFrame:
    """``digest``, ``ord``, ``anchors`` (distinct) and how many ``times`` the text has each."""

    def find(batches):
        for b in batches:
            once, times = [], []
            for t in b.column(2):
                h, n = np.unique(anchors(word_hashes(t.as_buffer()), width, anchor)[0].view(np.int64),
                                 return_counts=True)
                once.append(h)
                times.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(once, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                names=["digest", "ord", "anchors", "times"])

    return texts.select("digest", "ord", "t").mapInArrow(
        find, "digest binary, ord bigint, anchors array<bigint>, times array<int>")


def _contexts(found: DataFrame, width: int, anchor: int) -> DataFrame:
    """A row per wanted anchor of a text: the words its windows cover, as 8-byte hashes, ``left`` of them before it."""

    def cut(batches):
        for b in batches:
            digest, order, text, wanted, salts = (b.column(i) for i in range(5))
            for i in range(b.num_rows):
                words = word_hashes(text[i].as_buffer())
                h, place, first, n = anchors(words, width, anchor)
                want = wanted[i].values.to_numpy().view(np.uint64)
                sort = np.argsort(want)
                at = np.searchsorted(want[sort], h).clip(0, len(want) - 1)
                use = np.flatnonzero(want[sort][at] == h)
                if not len(use):
                    continue
                of = salts[i].values.to_numpy()[sort][at[use]]
                raw, start = words.tobytes(), first[use]
                ends = start + n[use] + width - 1
                k = len(use)
                key = np.uint64(int.from_bytes(digest[i].as_py()[:8], "little"))
                salt = mix(key + start.astype(np.uint64)) % of.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[use].view(np.int64)), pa.array(salt.astype(np.int32)),
                    pa.array(of.astype(np.int32)), pa.array([order[i].as_py()] * k, pa.int64()),
                    pa.array([digest[i].as_py()] * k, pa.binary()), pa.array(start.astype(np.int32)), pa.array((place[use] - start).astype(np.int32)),
                    pa.array([raw[8 * s:8 * e] for s, e in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["anchor", "salt", "salts", "ord", "digest", "start", "left", "words"])

    return found.mapInArrow(
        cut, "anchor bigint, salt int, salts int, ord bigint, digest binary, start int, left int, words binary")


def suffix_order(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and symbols, and how many symbols each shares with the one before (-1 in another group)."""
    sort = np.lexsort((*symbols.T[::-1], group))
    s, g = symbols[sort], group[sort]
    shared = np.full(len(sort), -1)
    same = np.logical_and.accumulate(s[1:] == s[:-1], axis=1).sum(axis=1)
    shared[1:] = np.where(g[1:] == g[:-1], same, -1)
    return sort, shared


def nodes(sort: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node of every row at a depth: the rows between two that share fewer symbols."""
    node = np.empty(len(sort), dtype=np.int64)
    node[sort] = np.cumsum(shared < depth)
    return node


def _symbols(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The words at the places ``at``, 0 outside ``low``..``high``."""
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, words[np.where(inside, at, 0)], np.uint64(0))


def _leaves(rows: list[pa.RecordBatch], width: int, anchor: int, sources: bool) -> pa.RecordBatch:
    """Nodes of whole subtrees.  Repeats as (ord, digest, start, bits), with ``sources`` one a window and with the
    first leaf of its node; then the first leaf of every node of a split subtree, with the node's two hashes."""
    t = pa.Table.from_batches(rows).combine_chunks()
    order, start, left = (t[c].to_numpy().astype(np.int64) for c in ("ord", "start", "left"))
    digests = t["digest"].combine_chunks()
    digest = np.frombuffer(b"".join(digests.to_pylist()), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    contexts = t["words"].to_pylist()
    words = np.frombuffer(b"".join(contexts), dtype=np.uint64)
    high = np.cumsum([len(c) // 8 for c in contexts])
    low = np.concatenate([[0], high[:-1]])
    windows = high - low - width + 1
    key = np.stack([t["anchor"].to_numpy(), t["salt"].to_numpy().astype(np.int64)])
    group = np.cumsum(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
    place = low + left
    onward = suffix_order(_symbols(words, place[:, None] + np.arange(width), low, high), group)
    back = suffix_order(_symbols(words, place[:, None] - 1 - np.arange(width - anchor), low, high), group)

    spot = np.stack([order.astype(np.uint64), digest[:, 0], digest[:, 1], (start + left).astype(np.uint64)])
    rank = np.lexsort((spot[3], spot[2], spot[1], order))
    leaf = np.empty(len(rank), dtype=np.int64)  # rows of one document read twice are one leaf
    leaf[rank] = np.cumsum(np.concatenate([[True], (spot[:, rank][:, 1:] != spot[:, rank][:, :-1]).any(axis=0)]))

    none = np.empty(0, dtype=np.int64)
    split = t["salts"].to_numpy() > 1
    again, heads = [(none, none, none)], [(none, none)]
    for before in range(width - anchor + 1):
        shift = left - before
        use = rank[(shift[rank] >= 0) & (shift[rank] < windows[rank])]
        node = nodes(*onward, width - before)[use] * (len(rank) + 1) + nodes(*back, before)[use]
        _, first, which = np.unique(node, return_index=True, return_inverse=True)
        head = use[first]
        later = leaf[use] != leaf[head[which]]
        again.append((use[later], shift[use[later]], head[which][later]))
        head = head[split[head]]
        heads.append((head, shift[head]))
    row, shift, of = (np.concatenate(x) for x in zip(*again, strict=True))
    at = start[of] + left[of] - (left[row] - shift)
    bits = np.int64(1) << shift
    if not sources:
        some = np.zeros(len(rank), dtype=np.int64)
        np.bitwise_or.at(some, row, bits)
        row = np.flatnonzero(some)
        bits = some[row]
    head, move = (np.concatenate(x) for x in zip(*heads, strict=True))
    made = {r: [run_hashes(np.frombuffer(contexts[r], dtype=np.uint64), width, which) for which in (1, 2)]
            for r in np.unique(head).tolist()}
    hashes = [np.array([made[r][which][m] for r, m in zip(head.tolist(), move.tolist(), strict=True)],
                       dtype=np.uint64).view(np.int64) for which in (0, 1)]
    take = np.concatenate([row, head])
    zero, missing = np.zeros(len(row), dtype=np.int64), pa.nulls(len(head), pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.array(order[take]), digests.take(pa.array(take)),
        pa.array(np.concatenate([start[row], start[head] + move]).astype(np.int32)),
        pa.array(np.concatenate([bits, np.ones(len(head), dtype=np.int64)])),
        digests.take(pa.concat_arrays([pa.array(of.astype(np.int32)), missing]) if sources
                     else pa.nulls(len(take), pa.int32())),
        pa.concat_arrays([pa.array(at.astype(np.int32)), missing]) if sources else pa.nulls(len(take), pa.int32()),
        pa.array(np.concatenate([zero, hashes[0]])), pa.array(np.concatenate([zero, hashes[1]])),
        pa.array(np.arange(len(take)) >= len(row))],
        names=["ord", "digest", "start", "bits", "of", "at", "node", "node2", "head"])


def _subtrees(contexts: DataFrame, width: int, anchor: int, sources: bool) -> DataFrame:
    def compare(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # whole subtrees go on; the last one may continue in the next batch
            key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if held:
                last = held[-1]
                end = (last.column(0)[last.num_rows - 1].as_py(), last.column(1)[last.num_rows - 1].as_py())
                if end != (key[0, 0], key[1, 0]):
                    yield _leaves(held, width, anchor, sources)
                    held = []
            if len(cuts):
                n = int(cuts[-1]) + 1
                yield _leaves([*held, b.slice(0, n)], width, anchor, sources)
                held = [b.slice(n)]
            else:
                held.append(b)
        if held:
            yield _leaves(held, width, anchor, sources)

    return contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(
        compare, "ord bigint, digest binary, start int, bits bigint, of binary, at int, node bigint, node2 bigint, head boolean")


def _repeats(docs: DataFrame, id_col: str, text: str, width: int, anchor: int, group: int,
             sources: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct texts (``digest``, ``owner``), the leaves found in the parts, and the leaves of split nodes
    (``leaf``) that are not the ``first`` of all parts."""
    texts = _texts(docs, id_col, text)
    own = materialise(_with_anchors(texts, width, anchor).groupBy("digest").agg(
        F.min("ord").alias("owner"), F.first("anchors").alias("anchors"), F.first("times").alias("times")), "anchors")
    each = own.select("digest", "owner", F.explode("anchors").alias("anchor"))
    often = materialise(
        own.select(F.explode(F.arrays_zip("anchors", "times")).alias("a")).groupBy(F.col("a.anchors").alias("anchor"))
        .agg(F.sum("a.times").alias("n")).where("n > 1")
        .select("anchor", F.ceil(F.col("n") / group).cast("int").alias("salts")), "often")
    wanted = materialise(each.join(often, "anchor").groupBy("digest").agg(
        F.first("owner").alias("owner"), F.collect_list(F.struct("anchor", "salts")).alias("a")), "wanted")
    w = wanted.select(F.col("digest").alias("d"), "owner", F.col("a.anchor").alias("wanted"), F.col("a.salts").alias("salts"))
    found = texts.join(w, (texts.digest == w.d) & (texts.ord == w.owner)).select("digest", "ord", "t", "wanted", "salts")
    leaves = materialise(_subtrees(_contexts(found, width, anchor), width, anchor, sources), "leaves")
    heads = leaves.where("head").select("node", "node2", F.struct("ord", "digest", "start").alias("leaf")).distinct()
    first = heads.groupBy("node", "node2").agg(F.min("leaf").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = heads.join(first, ["node", "node2"]).where("leaf != first").select("leaf", "first")
    return own.select("digest", "owner"), leaves.where("not head"), later


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                     anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per distinct text: ``digest``, ``owner`` (smallest id), ``runs``: (start, bits) of its repeated windows."""
    own, leaves, later = _repeats(docs, id_col, text, width, anchor, group, sources=False)
    runs = leaves.select("digest", "start", "bits").unionAll(later.select(
        "leaf.digest", "leaf.start", F.lit(1).cast("bigint").alias("bits"))).groupBy("digest").agg(
        F.collect_list(F.struct("start", "bits")).alias("runs"))
    return materialise(own.join(runs, "digest", "left"), "repeats")


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                    anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """The repeats of ``width`` or more words between or within distinct texts (ids: the smallest with that text;
    null for texts of null ids alone): id, ``start``, ``n_words``, ``first_id``, ``first_start``, words counted from 0.

    Each window is set against the place where it comes first; windows that go on together in both places are one
    repeat, as long as it gets."""
    own, leaves, later = _repeats(docs, id_col, text, width, anchor, group, sources=True)
    start = F.expr("start + cast(log2(bits) as int)").alias("start")
    within = leaves.select("digest", start, "of", "at")
    moved = later.select(F.col("leaf.digest").alias("of"), F.col("leaf.start").alias("at"),
                         F.col("first.digest").alias("of2"), F.col("first.start").alias("at2"))
    pairs = within.join(moved, ["of", "at"], "left").select(
        "digest", "start", F.coalesce("of2", "of").alias("of"), F.coalesce("at2", "at").alias("at")).unionAll(
        later.select("leaf.digest", "leaf.start", "first.digest", "first.start"))
    along = Window.partitionBy("digest", "of", F.col("start") - F.col("at")).orderBy("start")
    spans = pairs.withColumn("run", F.col("start") - F.row_number().over(along)).groupBy(
        "digest", "of", (F.col("start") - F.col("at")).alias("gap"), "run").agg(
        F.min("start").alias("start"), (F.count(F.lit(1)) + width - 1).alias("n_words"))

    def name(c: str):
        return F.when(F.col(c) != LAST, F.col(c))

    a = own.select("digest", name("owner").alias("a"))
    b = own.select(F.col("digest").alias("of"), name("owner").alias("b"))
    return spans.join(a, "digest").join(b, "of").select(
        F.col("a").alias(id_col), F.col("start").cast("bigint"), "n_words", F.col("b").alias("first_id"),
        (F.col("start") - F.col("gap")).cast("bigint").alias("first_start"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH,
                   anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept`` (its other words, joined by one space)."""
    repeats = repeated_windows(docs, id_col, text, width, anchor, group)
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()

    def strip(batches):
        for b in batches:
            ids, order, owner, text_, runs = (b.column(i) for i in range(5))
            words_n, removed_n, kept = [], [], []
            for i in range(b.num_rows):
                words = text_[i].as_py().encode().split()
                n = len(words)
                covered = np.zeros(n, dtype=bool)
                if n >= width and order[i].as_py() != owner[i].as_py():
                    covered[:] = True
                elif runs[i].is_valid:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    run = runs[i].values
                    start = run.field("start").to_numpy().astype(np.int64)
                    bits = run.field("bits").to_numpy()
                    for j in range(width - anchor + 1):
                        s = start[(bits >> j) & 1 == 1] + j
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + width, -1)
                    covered = np.cumsum(edge)[:n] > 0
                words_n.append(n)
                removed_n.append(int(covered.sum()))
                kept.append(b" ".join(compress(words, ~covered)).decode())
            yield pa.RecordBatch.from_arrays(
                [ids.cast(id_type), pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()),
                 pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    d = _texts(docs, id_col, text).join(repeats.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    return d.select("doc_id", "ord", "owner", "t", "runs").mapInArrow(
        strip, f"`{id_col}` {'string' if kind == 'string' else 'bigint'}, n_words bigint, n_removed bigint, kept string")


def op4(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
p AS (SELECT doc_id, rid, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM (
        SELECT doc_id, rid, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
c AS (SELECT DISTINCT rid, i + j AS x FROM r, range(0, {WIDTH}) t(j)),
cs AS (SELECT rid, count(*) AS n, list(x) AS xs FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE (
           SELECT string_agg(w[k], ' ' ORDER BY k) FROM range(1, len(w) + 1) u(k) WHERE NOT list_contains(xs, k)) END, '')) AS kept_sha256
FROM d LEFT JOIN cs USING (rid)"""
