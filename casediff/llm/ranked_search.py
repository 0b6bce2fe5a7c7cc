"""Ranked lexical search with pair-bound MaxScore.

``build`` cuts the documents into segments, where they lie, and writes one row a
segment: the documents with their lengths, and a posting list (document, term
frequency) for each term of the queries.  The statistics of the whole collection
(N, L, document frequencies) are sums over the segments, and with them
``weigh`` adds what a query log allows to precompute: every posting's impact,
every term's largest impact, and for the pairs of terms that the queries pair up
the list of documents that hold both with its largest joint impact.

Answering runs over the segments twice.  First, the documents of a query's pair
lists with the largest joint impacts are scored in full; the ``top``-th best of
them over all segments is a score that a result must reach.  Then, in each
segment, a query's terms are ordered by their maxima.  Two paired terms can add
no more together than the larger of their joint maximum and their two own maxima,
which for terms that seldom meet is far less than the sum.  As many of the first
terms as stay below the threshold by these bounds cannot lift a document into the
result by themselves, so only documents of the other terms' lists are candidates;
and before each further list those that the bounds of what is left cannot lift
over the threshold drop out.  Bounds only skip work: the ranking is exact, and
equal to scoring all documents.

Nothing of a document's text leaves its task but its postings, and a segment
gives at most ``top`` rows a query, so nothing is gathered in one task.  Queries
come in blocks of ``BLOCK_TERMS`` distinct terms at most (a single query may have
more), each with its own index.

Edge cases: null and empty texts have no terms; a query without terms has no
rows; a repeated item is a query of its own; repeated documents all rank; a null
document id ranks after equal scores; a text is read whole, however long; an
empty table on either side gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

TOP = 20
#: Distinct terms of the queries that are answered together; their dictionary goes to every task.
BLOCK_TERMS = 200_000
#: Documents and postings of a segment at most (a single document may have more postings).
SEGMENT_DOCS, SEGMENT_POSTINGS = 8_192, 400_000
#: Documents scored in each segment to find a query's threshold, times ``top``.
SEEDS = 8
#: Terms are runs of ASCII letters, digits and bytes beyond ASCII, after A-Z were lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of a long text that are read at a time.
PIECE = 1 << 20
SEGMENT = ("segment string, n_docs bigint, n_terms bigint, ids binary, null_ids binary, lengths binary, terms binary, "
           "starts binary, docs binary, tfs binary")
WEIGHED = SEGMENT + ", impacts binary, pair_starts binary, pair_docs binary, joint binary"
Query = tuple[int, list[tuple[int, int]]]  # number, (term, times it occurs)


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data = (text or "").encode().lower()
    if len(data) <= PIECE:
        yield TERM.findall(data)
        return
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and TERM.match(data, end, end + 1):
            end += 1
        yield TERM.findall(data, at, end)
        at = end


def _packed(a, kind) -> bytes:
    return np.asarray(a, dtype=kind).tobytes()


def build(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a segment of the documents' index over ``vocabulary``."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches):
        known, part, made = sent.value, TaskContext.get().partitionId(), 0
        ids, nulls, lengths, found_terms, found_docs, found_tfs = (array(kind) for kind in "qbqiiq")

        def segment():
            nonlocal made
            terms = np.array(found_terms, dtype=np.int32)
            order = np.argsort(terms, kind="stable")
            terms, starts = np.unique(terms[order], return_index=True)
            row = [f"{part}-{made}", len(ids), sum(lengths), _packed(ids, np.int64), _packed(nulls, np.bool_),
                   _packed(lengths, np.int64), terms.tobytes(), _packed([*starts, len(order)], np.int64),
                   np.array(found_docs, dtype=np.int32)[order].tobytes(),
                   np.array(found_tfs, dtype=np.int64)[order].tobytes()]
            made += 1
            for held in (ids, nulls, lengths, found_terms, found_docs, found_tfs):
                del held[:]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=SEGMENT_NAMES)

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                n, tf = 0, Counter()
                for some in terms_of(t.as_py()):
                    n += len(some)
                    tf.update(some)
                if not n:
                    continue
                i = i.as_py()
                for term in tf.keys() & known.keys():
                    found_terms.append(known[term])
                    found_docs.append(len(ids))
                    found_tfs.append(tf[term])
                ids.append(0 if i is None else i)
                nulls.append(i is None)
                lengths.append(n)
                if len(ids) >= SEGMENT_DOCS or len(found_terms) >= SEGMENT_POSTINGS:
                    yield segment()
        if ids:
            yield segment()

    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(index, SEGMENT)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


SEGMENT_NAMES, WEIGHED_NAMES = _names(SEGMENT), _names(WEIGHED)


class Segment:
    """A row of the index, as arrays."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.ids, self.null_ids, self.lengths = get("ids", np.int64), get("null_ids", np.bool_), get("lengths", np.int64)
        self.terms, self.starts = get("terms", np.int32), get("starts", np.int64)
        self.docs, self.tfs = get("docs", np.int32), get("tfs", np.int64)
        if "impacts" in row:
            self.impacts = get("impacts", np.int64)
            self.most = np.maximum.reduceat(self.impacts, self.starts[:-1]) if len(self.terms) else self.impacts
            self.pair_starts, self.pair_docs = get("pair_starts", np.int64), get("pair_docs", np.int32)
            self.joint = get("joint", np.int64)

    def place(self, term: int) -> int:
        """The number of a term's list here, or -1."""
        i = int(np.searchsorted(self.terms, term))
        return i if i < len(self.terms) and self.terms[i] == term else -1

    def postings(self, place: int) -> slice:
        return slice(int(self.starts[place]), int(self.starts[place + 1]))

    def added(self, place: int, docs: np.ndarray) -> np.ndarray:
        """Impacts of a term in the given rising documents (0 where it does not occur); the shorter side is looked up
        in the longer one."""
        lies = self.postings(place)
        listed, impacts = self.docs[lies], self.impacts[lies]
        if len(listed) > len(docs):
            i = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
            return np.where(listed[i] == docs, impacts[i], 0)
        out = np.zeros(len(docs), dtype=np.int64)
        if len(docs):
            i = np.minimum(np.searchsorted(docs, listed), len(docs) - 1)
            there = docs[i] == listed
            out[i[there]] = impacts[there]
        return out


def _segments(batches) -> Iterator[tuple[dict, Segment]]:
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            yield row, Segment(row)


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the document frequencies of the vocabulary's terms."""
    def df(batches):
        for _, s in _segments(batches):
            yield pa.RecordBatch.from_arrays([pa.array(s.terms), pa.array(np.diff(s.starts))], names=["term", "df"])

    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = index.mapInArrow(df, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return n or 0, length or 0, {r["term"]: r["df"] for r in found}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def pair_up(queries: list[Query], weights: np.ndarray) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """The pairs of terms whose lists are intersected, and each query's pairs: its terms by falling weight, two and
    two, so that terms of like impact, which seldom meet when they are rare, share a bound."""
    numbers: dict[tuple[int, int], int] = {}
    of_query = []
    for _, terms in queries:
        order = sorted((t for t, _ in terms), key=lambda t: (-weights[t], t))
        pairs = [tuple(sorted(order[i:i + 2])) for i in range(0, len(order) - 1, 2)]
        of_query.append([numbers.setdefault(p, len(numbers)) for p in pairs])
    return list(numbers), of_query


def weigh(index: DataFrame, n: int, length: int, weights: np.ndarray, pairs: list[tuple[int, int]]) -> DataFrame:
    """The index with impacts, pair lists and their joint maxima."""
    sent = index.sparkSession.sparkContext.broadcast((weights, pairs))

    def add(batches):
        w, wanted = sent.value
        for row, s in _segments(batches):
            m = 100 - 25 + (25 * s.lengths * n) // length
            s.impacts = np.repeat(w[s.terms], np.diff(s.starts)) * (
                (1_000_000_000 * s.tfs) // (1000 * s.tfs + 12 * m[s.docs]))
            starts, both, joint = [0], [], []
            for a, b in wanted:
                i, j = s.place(a), s.place(b)
                docs, most = np.empty(0, dtype=np.int32), 0
                if i >= 0 and j >= 0:
                    x, y = s.postings(i), s.postings(j)
                    docs, at, bt = np.intersect1d(s.docs[x], s.docs[y], assume_unique=True, return_indices=True)
                    if len(docs):
                        sums = s.impacts[x][at] + s.impacts[y][bt]
                        most = int(sums.max())
                        # the list starts with the best documents, so that a query finds its first candidates there
                        docs = docs[np.argsort(-sums, kind="stable")]
                both.append(docs)
                starts.append(starts[-1] + len(docs))
                joint.append(most)
            row |= {"impacts": s.impacts.tobytes(), "pair_starts": _packed(starts, np.int64),
                    "pair_docs": np.concatenate([*both, np.empty(0, dtype=np.int32)]).astype(np.int32).tobytes(),
                    "joint": _packed(joint, np.int64)}
            yield pa.RecordBatch.from_arrays([pa.array([row[c]]) for c in WEIGHED_NAMES], names=WEIGHED_NAMES)

    return index.mapInArrow(add, WEIGHED)


def _whole_scores(s: Segment, terms: list[tuple[int, int]], docs: np.ndarray) -> np.ndarray:
    score = np.zeros(len(docs), dtype=np.int64)
    for t, times in terms:
        if (p := s.place(t)) >= 0:
            score += times * s.added(p, docs)
    return score


def seeds(s: Segment, terms: list[tuple[int, int]], pairs: list[int], top: int) -> np.ndarray:
    """Scores of some documents: the first of the pair lists with the largest joint impacts, and where these are few,
    of the terms' own lists."""
    docs, n = [np.empty(0, dtype=np.int32)], 0
    for p in sorted((p for p in pairs if s.joint[p] > 0), key=lambda p: -s.joint[p]):
        docs.append(s.pair_docs[s.pair_starts[p]:min(s.pair_starts[p + 1], s.pair_starts[p] + 2 * top)])
        n += len(docs[-1])
        if n >= SEEDS * top:
            break
    for _, p in sorted(((int(s.most[p]), p) for t, _ in terms if (p := s.place(t)) >= 0), reverse=True):
        if n >= SEEDS * top:
            break
        docs.append(s.docs[s.postings(p)][:2 * top])
        n += len(docs[-1])
    score = np.sort(_whole_scores(s, terms, np.unique(np.concatenate(docs))))[::-1][:top]
    return score[score > 0]


def _bounded(s: Segment, terms: list[tuple[int, int]], pairs: list[int], named: list[tuple[int, int]], by_pair: bool):
    """The query's lists that occur here, (list, times) by rising maximum, and for each number of them, from 0 on, what
    so many of the first can add together: a pair counts with its own bound once both of its terms are among them."""
    times = dict(terms)
    lists = sorted((times[t] * int(s.most[p]), p, t) for t in times if (p := s.place(t)) >= 0)
    most, partner = {t: u for u, _, t in lists}, {}
    for number in pairs if by_pair else []:
        a, b = named[number]
        if a in most and b in most:
            x, y = times[a], times[b]
            low = min(x, y)
            joint = low * int(s.joint[number]) + (x - low) * (most[a] // x) + (y - low) * (most[b] // y)
            bound = max(most[a], most[b], joint if s.joint[number] else 0)
            partner[a], partner[b] = (b, bound), (a, bound)
    bounds, seen = [0], set()
    for u, _, t in lists:
        other, bound = partner.get(t, (None, 0))
        bounds.append(bounds[-1] + (bound - most[other] if other in seen else u))
        seen.add(t)
    return [(p, times[t]) for _, p, t in lists], bounds


def best(s: Segment, terms: list[tuple[int, int]], pairs: list[int], named: list[tuple[int, int]], top: int,
         threshold: int, by_pair: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of the segment's ``top`` results that reach ``threshold``, and the postings looked at.

    ``by_pair=False`` leaves the pairs out: plain MaxScore."""
    lists, bounds = _bounded(s, terms, pairs, named, by_pair)
    rest = sum(x < threshold for x in bounds[1:])  # so many lists cannot lift a document into the result together
    score = np.zeros(len(s.ids), dtype=np.int64)
    read = 0
    for p, times in lists[rest:]:
        lies = s.postings(p)
        score[s.docs[lies]] += times * s.impacts[lies]
        read += lies.stop - lies.start
    docs = np.flatnonzero(score)
    score = score[docs]
    for i in range(rest, 0, -1):
        stay = score + bounds[i] >= threshold
        docs, score = docs[stay], score[stay]
        if not len(docs):
            break
        p, times = lists[i - 1]
        score = score + times * s.added(p, docs)
        read += min(len(docs), len(s.docs[s.postings(p)]))
    good = score >= max(threshold, 1)
    docs, score = docs[good], score[good]
    if len(docs) > top:
        good = score >= np.partition(score, len(score) - top)[len(score) - top]
        docs, score = docs[good], score[good]
        good = np.lexsort((s.ids[docs], s.null_ids[docs], -score))[:top]
        docs, score = docs[good], score[good]
    return docs, score, read


def thresholds(index: DataFrame, queries: list[Query], of_query: list[list[int]], top: int) -> dict[int, int]:
    """For each query a score that its ``top``-th result reaches."""
    sent = index.sparkSession.sparkContext.broadcast((queries, of_query))

    def score(batches):
        asked, pairs = sent.value
        for _, s in _segments(batches):
            some = [(q, seeds(s, terms, own, top)) for (q, terms), own in zip(asked, pairs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _ in some], [len(x) for _, x in some])),
                 pa.array(np.concatenate([x for _, x in some]))], names=["q", "score"])

    found = index.mapInArrow(score, "q bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    kept = found.withColumn("rank", rank).where(F.col("rank") <= top).where(F.col("rank") == top)
    return {r["q"]: r["score"] for r in kept.collect()}


def _answer(docs: DataFrame, queries: list[tuple[int, Counter]], top: int, id_col: str, text: str) -> DataFrame:
    """``q``, ``rank``, ``doc_id``, ``score`` of one block of queries."""
    words = sorted(set().union(*(c.keys() for _, c in queries)))
    vocabulary = {t: i for i, t in enumerate(words)}
    asked: list[Query] = [(q, sorted((vocabulary[t], n) for t, n in c.items())) for q, c in queries]
    index = materialise(build(docs, vocabulary, id_col, text), "search-index")
    n, length, df = statistics(index)
    weights = np.array([weight(n, df.get(i, 0)) for i in range(len(words))], dtype=np.int64)
    named, of_query = pair_up(asked, weights)
    index = materialise(weigh(index, n, length, weights, named), "search-pairs")
    sent = docs.sparkSession.sparkContext.broadcast((asked, named, of_query, thresholds(index, asked, of_query, top)))

    def look(batches):
        mine, pairs, own, least = sent.value
        for _, s in _segments(batches):
            some = [(q, *best(s, terms, numbers, pairs, top, least.get(q, 0))[:2])
                    for (q, terms), numbers in zip(mine, own, strict=True)]
            d = np.concatenate([x for _, x, _ in some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _, _ in some], [len(x) for _, x, _ in some])),
                 pa.array(s.ids[d], mask=s.null_ids[d]), pa.array(np.concatenate([x for _, _, x in some]))],
                names=["q", "doc_id", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (index.mapInArrow(look, "q bigint, doc_id bigint, score bigint")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("q", "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS,
                   item_id: str = "item_id", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``top`` best documents."""
    spark = docs.sparkSession
    numbered = materialise(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).alias("item_id"),
                                        F.col(text).cast("string").alias("item_text")), "queries")
    out = None
    block: dict[int, Counter] = {}
    seen: set[bytes] = set()
    # queries come to the driver one by one, and leave it in blocks of a bounded number of terms
    for r in numbered.orderBy("q").toLocalIterator():
        terms = Counter(t for some in terms_of(r["item_text"]) for t in some)
        if block and len(seen | terms.keys()) > block_terms:
            found = _answer(docs, list(block.items()), top, id_col, text)
            out = found if out is None else out.unionByName(found)
            block, seen = {}, set()
        if terms:
            block[r["q"]] = terms
            seen |= terms.keys()
    if block:
        found = _answer(docs, list(block.items()), top, id_col, text)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "q bigint, rank int, doc_id bigint, score bigint")
    return out.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT item_id, row_number() OVER () AS q, {_TERMS} AS w FROM benchmark),
e AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM i) GROUP BY q, t),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM e) GROUP BY rid, t),
f AS (SELECT t, floor(1000 * ln((2 * s.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, s.n),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(w) * s.n) // s.l) AS m FROM d, s),
x AS (SELECT q, doc_id, rid, sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM e JOIN p USING (t) JOIN f USING (t) JOIN m USING (rid) GROUP BY q, doc_id, rid),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN i USING (q) WHERE rank <= {TOP}"""
