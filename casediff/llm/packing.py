"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A document (its ids and one end id) is cut into whole sequences, then halves,
quarters ... of the capacity down to ``finest``, and one tail shorter than that.
Piece lengths fall into reciprocal classes: class k holds lengths in
(C/(k+1), C/k], and a bin of class k takes exactly k pieces, whatever comes next.
So every worker fills its bins alone while it tokenises, with at most k - 1
pieces of each class waiting, and no piece is compared with another.

The pieces that wait at the end of a worker (a bounded number each, a vanishing
share of the whole) are packed by the same rule in rounds, ``FAN`` workers to a
group, until one group is left; its rest is packed first-fit decreasing, so that
no class leaves a half-empty sequence of its own.

Cut pieces: halving makes classes 1, 2, 4 ... exact, so only tails (shorter than
``finest``) can leave room, at most ``finest`` ids in a sequence of theirs.

Edge cases: a null or empty text is one piece, the end id; repeated rows are
packed one by one; a very long text is encoded whole by one task and cut into pieces
like any other (one with a run of ``tokens.LONG_RUN`` blanks or non-blanks by the library
that takes it); an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, text_or_empty
from .tokens import Encoder

CAPACITY, FINEST, END_ID = 2048, 128, 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Workers whose waiting pieces meet in one group of a later round.
FAN = 64
PIECE = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
         "offset bigint, worker bigint")
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
#: sequence_id: round, worker and count in 6, 24 and 33 bits.
_ROUND, _WORKER = 57, 33


def cut(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= finest:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] if rest else out


class Bins:
    """Open bins of each class; ``add`` returns a bin's pieces when it is full."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, {}

    def add(self, length: int, piece) -> list | None:
        k = self.capacity // length
        waiting = self.open.setdefault(k, [])
        waiting.append(piece)
        if len(waiting) == k:
            return self.open.pop(k)
        return None

    def rest(self) -> list:
        return [p for k in sorted(self.open) for p in self.open[k]]


def _placed(pieces: list[tuple], sequence: int) -> Iterator[tuple]:
    at = 0
    for p in pieces:
        yield (*p, sequence, at)
        at += p[2]


def first_fit(pieces: list[tuple], capacity: int) -> Iterator[list[tuple]]:
    """Bins filled with the longest waiting piece that still fits, again and again."""
    from bisect import bisect_right
    by_length: dict[int, list] = {}
    for p in pieces:
        by_length.setdefault(p[2], []).append(p)
    lengths = sorted(by_length)
    while lengths:
        room, got = capacity, []
        while i := bisect_right(lengths, room):
            n = lengths[i - 1]
            got.append(by_length[n].pop())
            room -= n
            if not by_length[n]:
                lengths.pop(i - 1)
        yield got


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)


def _round(turn: int, last: bool, capacity: int, fan: int):
    """The function that packs what ``fan`` workers have left."""

    def again(group: pd.DataFrame) -> pd.DataFrame:
        worker = int(group["worker"].iloc[0]) // fan
        base = (turn << _ROUND) + (worker << _WORKER)
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"])
        cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        pieces = list(zip(*[[None if v is pd.NA else int(v) for v in group[c].astype("Int64")] for c in cols],
                          strict=True))
        bins, full = Bins(capacity), []
        for p in pieces:
            got = bins.add(p[2], p)
            if got is not None:
                full.append(got)
        rest = bins.rest()
        if last:
            full += first_fit(rest, capacity)
            rest = []
        rows = [(*p, worker) for i, got in enumerate(full) for p in _placed(got, base + i)]
        rows += [(*p, None, None, worker) for p in rest]
        columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
        # straight to nullable integers: by way of floats the sequence numbers would lose digits
        return pd.DataFrame({n: pd.array(c, dtype="Int64") for n, c in zip(_ARROW.names, columns, strict=True)})

    return again


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
         ranks: str | None = RANKS, capacity: int = CAPACITY, finest: int = FINEST, end_id: int = END_ID,
         fan: int = FAN) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``."""

    def work(batches):
        encode = Encoder(tokenizer, ranks)
        worker, bins, n_full = TaskContext.get().partitionId(), Bins(capacity), 0
        for batch in batches:
            out = []
            ids_of, text_of = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                doc = ids_of[i].as_py()
                ids = np.array([*encode(text_of[i].as_py()), end_id], dtype="<u4")
                start = 0
                for n in cut(len(ids), capacity, finest):
                    crc = zlib.crc32(ids[start:start + n].tobytes())
                    full = bins.add(n, (doc, start, n, crc, len(ids)))
                    if full is not None:
                        out += [(*p, worker) for p in _placed(full, (worker << _WORKER) + n_full)]
                        n_full += 1
                    start += n
            if out:
                yield _batch(out)
        rest = [(*p, None, None, worker) for p in bins.rest()]
        if rest:
            yield _batch(rest)

    first = materialise(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))
                        .mapInArrow(work, PIECE), "pieces")
    done = [first.where("sequence_id is not null")]
    waiting, turn = first.where("sequence_id is null"), 1
    workers = 1 + (first.agg(F.max("worker")).first()[0] or 0)
    while True:
        last = workers <= fan

        key = F.floor(F.col("worker") / fan)
        packed = waiting.groupBy(key).applyInPandas(_round(turn, last, capacity, fan), PIECE)
        if last:
            done.append(packed)
            break
        packed = materialise(packed, "pieces")
        done.append(packed.where("sequence_id is not null"))
        waiting, turn, workers = packed.where("sequence_id is null"), turn + 1, -(-workers // fan)
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.drop("worker")


def op2(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
