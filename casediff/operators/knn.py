"""Exact k-nearest-neighbour joins.

Input tables carry ``id BIGINT``, ``x ARRAY<DOUBLE>`` (numeric features) and,
for mixed metrics, ``codes ARRAY<INT>`` (nominal value codes, see
:mod:`casediff.operators.vdm`).  The output is a long neighbour table::

    query_id BIGINT, neighbour_id BIGINT, [by], rank INT, dist DOUBLE, d2r DOUBLE, carried...

``d2r`` is the squared distance to 12 significant digits; neighbours are ranked by
``(d2r, neighbour_id)`` so that ties break identically in every engine, whatever
the unit of the features.

Missing values: a null, NaN or infinite feature is missing, and a feature that is
missing on either side adds 1 to the squared distance; a null vector misses all
features, a null code counts as the unknown value.  So no row is lost.  Vectors
of different lengths are an error, not a distance.

Ids must not be null.  A null value of ``by`` or of a group column is a value of
its own.

Physical plan
-------------
Spark has no spatial index, and a theta join followed by a window would
materialise ``|Q| x |C|`` rows.  Instead the join is *blocked*:

* **dictionary** (before any of the plans): of cases that agree in vector, codes,
  class and group only the ``k + 1`` with the smallest ids can be neighbours, so
  where vectors repeat only those stay; a task compares each distinct query
  vector once and expands the answer to its queries.
* **cells** (large tables, see :mod:`casediff.operators.knn_cells`): cases lie in
  cells around pivots, and a query visits only the cells that the triangle
  inequality cannot rule out.
* **groups** (large tables with ``match_group``): both sides meet per group, large
  groups in blocks.
* **tiles** (without numeric features, and for random neighbours): queries get a block ``hash(id) % Bq`` and are
  copied once per case block; cases get ``hash(id) % Bc`` and are copied once
  per query block, so blocks never come from a data value.  Where a distance has nominal
  codes or few features, a task sorts its cases in strips and leaves out what cannot be
  near (see :mod:`casediff.operators.knn_strips`).
* **broadcast** (small case base, size checked before it is collected): the
  case base is shipped once to every executor as one Arrow table and each query
  partition is scored in place with ``mapInPandas`` -- no shuffle at all.

Cells, groups and tiles first write both sides to the scratch folder with a row
number.  In cells and groups a task gets the cases of a block before the queries that
meet it, keeps the block as one matrix of at most ``tile_bytes`` and reads its queries
as a stream of Arrow batches, so its memory follows the block and not the number of
queries; tiles are a cogroup of bounded sides.  A task emits ids, distances and row numbers of its local top-k only.  A window
``row_number() <= k`` per query merges these candidates, and the columns of
``carry`` and ``keep`` are joined to the k that are left, by row number.

No path emits a pair that is not a top-k candidate.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casediff.session import scratch_path

# Elements of a distance chunk held at once inside a task (float64 -> 16 MiB).
_CHUNK_ELEMS = 2_000_000
# Answers of a tile's queries at most, of all values of ``by``.
_TILE_ANSWERS = 500_000
# Rows of an Arrow batch that a task hands on, and queries that it compares at once.
_OUT_ROWS, _ASKED_ROWS = 4096, 2048
# From this many numeric dimensions on, Euclidean candidates are pre-selected
# with a BLAS product and the exact distance is re-computed for them only.
_BLAS_MIN_DIM = 4
_EPS = np.finfo(np.float64).eps
# Modulus and multiplier of the MINSTD generator, and its square (two steps),
# used for seeded hashing; products stay below 2^63.
_LEHMER_M = 2147483647
_LEHMER_A = 48271
_LEHMER_A2 = 182605794


@dataclass(frozen=True)
class DistanceSpec:
    """How the distance between two cases is computed.

    ``numeric``: ``"sq"`` adds ``(a-b)^2`` per numeric dimension (Euclidean,
    HVDM numeric part); ``"clip"`` adds ``min(1, |a-b|)^2`` and counts a null
    as 1 (CVDHM, M5).
    ``tables``: one square matrix per nominal code column holding the
    *squared* per-feature contribution for each pair of codes, or an object that computes
    them (``vdm.ProfileTable``).  The last code of each is "unknown" (null or unseen).
    ``final``: ``"sqrt"`` (M1, M3, M7) or ``"half"`` (``sum / 2``, M6).
    ``random_seed``: when set, the "distance" is a seeded hash of the pair,
    so the top-k is a random sample per query (K6).
    """

    numeric: str = "sq"
    tables: tuple = field(default_factory=tuple)
    final: str = "sqrt"
    random_seed: int | None = None

    def nbytes(self) -> int:
        return int(sum(t.nbytes if hasattr(t, "nbytes") else np.asarray(t).nbytes for t in self.tables))

    def unknown(self) -> tuple[int, ...]:
        """The code of a missing value, per nominal feature."""
        return tuple(len(t) - 1 for t in self.tables)


EUCLIDEAN = DistanceSpec()


def random_order(seed: int) -> DistanceSpec:
    """Seeded random order of the cases, independent per query (K6)."""
    return DistanceSpec(random_seed=int(seed))


# --------------------------------------------------------------------------
# NumPy kernel (runs inside tasks)
# --------------------------------------------------------------------------


def _mix(v: np.ndarray) -> np.ndarray:
    """Two MINSTD steps: ``(v mod M) * A^2 mod M``."""
    return (np.mod(v, _LEHMER_M) * _LEHMER_A2) % _LEHMER_M


def _pair_hash(qid: np.ndarray, cid: np.ndarray, seed: int) -> np.ndarray:
    """Seeded score of a (query, case) pair, independent per query.

    ``h = mix(q + seed); s = mix(h xor c); s = mix(s xor (s >> 15))`` -- exact
    integer arithmetic, so the SQL oracle computes the same value.
    """
    h = _mix(qid.astype(np.int64) + seed)
    s = _mix(np.bitwise_xor(h[:, None], np.mod(cid.astype(np.int64), _LEHMER_M)[None, :]))
    s = _mix(np.bitwise_xor(s, np.right_shift(s, 15)))
    return s.astype(np.float64)


def _exact_sq(qx, cx, qc, cc, spec: DistanceSpec) -> np.ndarray:
    """Squared distance matrix, summed feature by feature (left to right)."""
    nq, nc = qx.shape[0], cx.shape[0]
    d2 = np.zeros((nq, nc), dtype=np.float64)
    tmp = np.empty((nq, nc), dtype=np.float64)
    for j in range(qx.shape[1]):
        np.subtract(qx[:, j, None], cx[None, :, j], out=tmp)
        if spec.numeric == "clip":
            np.abs(tmp, out=tmp)
            np.minimum(tmp, 1.0, out=tmp)
        tmp[np.isnan(tmp)] = 1.0
        np.multiply(tmp, tmp, out=tmp)
        d2 += tmp
    for f, table in enumerate(spec.tables):
        if hasattr(table, "matrix"):
            d2 += table.matrix(qc[:, f], cc[:, f])
        else:
            d2 += np.asarray(table)[qc[:, f][:, None], cc[:, f][None, :]]
    return d2


def _pair_sq(qx, cx, qc, cc, rows, cols, spec: DistanceSpec) -> np.ndarray:
    """Exact squared distance for selected (row, col) pairs only."""
    d2 = np.zeros(rows.shape[0], dtype=np.float64)
    for j in range(qx.shape[1]):
        diff = qx[rows, j] - cx[cols, j]
        if spec.numeric == "clip":
            diff = np.minimum(np.abs(diff), 1.0)
        diff[np.isnan(diff)] = 1.0
        d2 += diff * diff
    for f, table in enumerate(spec.tables):
        d2 += table.pairs(qc[rows, f], cc[cols, f]) if hasattr(table, "pairs") else np.asarray(table)[qc[rows, f], cc[cols, f]]
    return d2


def _candidates(qid, qx, qc, cid, cx, cc, k, exclude_self, spec, qg=None, cg=None, cap=None):
    """(row, col, d2) triplets containing every top-k pair (ties included).

    ``cap``: for each query a squared distance beyond which none of its first k lies (infinite: not known)."""
    nq, nc = qx.shape[0], cx.shape[0]
    dropped = None                    # pairs that are no neighbours, whatever their distance
    if qg is not None:
        dropped = qg[:, None] == cg[None, :]
    if exclude_self:
        same = qid[:, None] == cid[None, :]
        dropped = same if dropped is None else dropped | same
    product = exact = None
    if spec.random_seed is not None:
        exact = _pair_hash(qid, cid, spec.random_seed)
    elif spec.numeric == "sq" and not spec.tables and qx.shape[1] >= _BLAS_MIN_DIM:
        qn = np.einsum("ij,ij->i", qx, qx)
        cn = np.einsum("ij,ij->i", cx, cx)
        # Missing values (NaN) and overflowing squares take the exact way.
        if math.isfinite(4.0 * (float(qn.max(initial=0.0)) + float(cn.max(initial=0.0)))):
            product = qx @ cx.T       # |q - c|^2 = |q|^2 - 2 (q.c - |c|^2 / 2)
            product -= cn / 2.0
            # Error of the expansion is below ~2 d u (|q|^2 + |c|^2); the relative grain
            # keeps pairs that tie with the k-th after rounding to 12 digits.
            err = 8.0 * qx.shape[1] * _EPS * (qn + cn.max(initial=0.0))
    if product is None and exact is None:
        exact = _exact_sq(qx, cx, qc, cc, spec)

    def within(bound):
        """Products of the pairs whose distance may lie within the bound."""
        return (qn - bound - 2e-11 * np.abs(np.where(np.isfinite(bound), bound, 0.0)) - err) / 2.0

    mask = None
    if product is not None and cap is not None and np.isfinite(cap).all():
        mask = product >= within(cap)[:, None]
        if np.count_nonzero(mask) > nq * (8 * k + 64):
            mask = None               # a wide cap: the k-th of the chunk is closer
    if mask is None:
        if product is not None:
            base = np.multiply(product, -2.0, out=product)
            base += qn[:, None]
        else:
            base = exact if spec.random_seed is not None else _digits(exact)
        if dropped is not None:
            base[dropped] = np.inf
        kk = min(k, nc)
        if kk < nc:
            kth = np.partition(base, kk - 1, axis=1)[:, kk - 1]
        else:
            kth = np.full(nq, np.inf)
        if product is not None:
            tol = 2e-11 * np.abs(np.where(np.isfinite(kth), kth, 0.0)) + err
            mask = base <= (kth + tol)[:, None]
        else:
            mask = base <= kth[:, None]
    if dropped is not None:
        mask &= ~dropped
    rows, cols = np.nonzero(mask)
    if exact is not None:
        d2 = exact[rows, cols]
    else:
        d2 = _pair_sq(qx, cx, qc, cc, rows, cols, spec)
    return rows, cols, d2


def _digits(d2: np.ndarray) -> np.ndarray:
    """Squared distances to 12 significant digits, whatever the unit: enough to
    rank by, and values that differ only in the order of summation tie."""
    d2 = np.asarray(d2, dtype=np.float64)
    fine = np.isfinite(d2) & (d2 > 0)
    unit = np.power(10.0, np.floor(np.log10(np.where(fine, d2, 1.0))) - 11)
    return np.where(fine, np.round(d2 / unit) * unit, np.where(np.isfinite(d2), 0.0, d2))


def _select(rows, cols, d2, cid, k, random: bool):
    """Keep the first k per row ordered by (d2 to 12 digits, neighbour id)."""
    key = d2 if random else _digits(d2)
    order = np.lexsort((cid[cols], key, rows))
    rows, cols, d2, key = rows[order], cols[order], d2[order], key[order]
    if rows.size == 0:
        return rows, cols, d2, key, rows
    start = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    first = np.repeat(start, np.diff(np.r_[start, rows.size]))
    rank = np.arange(rows.size) - first + 1
    keep = rank <= k
    return rows[keep], cols[keep], d2[keep], key[keep], rank[keep]


def _stack(col, width: int) -> np.ndarray:
    """Vectors of an Arrow column as the rows of a matrix; whatever is missing becomes NaN."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.list_(pa.float64()))
    there = np.asarray(col.is_valid())
    sizes = col.value_lengths().fill_null(width).to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"a vector has {sizes[sizes != width][0]} entries, the case base {width}")
    flat = col.flatten().to_numpy(zero_copy_only=False).reshape(int(there.sum()), width)
    if there.all() and np.isfinite(flat).all():
        return flat
    out = np.full((len(col), width), np.nan)
    out[there] = np.where(np.isfinite(flat), flat, np.nan)
    return out


def _ids(col) -> np.ndarray:
    if col.null_count:
        raise ValueError("a case or query has a null id")
    return col.to_numpy().astype(np.int64, copy=False)


def _as_matrix(rows, width: int, unknown: tuple[int, ...]):
    """Ids, features and codes; ``unknown`` holds the code of a missing value per nominal feature."""
    ids = _ids(rows.column("id"))
    x = _stack(rows.column("x"), width)
    if unknown:
        codes = _stack(rows.column("codes"), len(unknown))
        codes = np.where(np.isnan(codes), np.asarray(unknown), codes).astype(np.int64)
    else:
        codes = np.zeros((rows.num_rows, 0), dtype=np.int64)
    return ids, x, codes


def _codes_of(col) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values of an Arrow column, and the values; a null is a value of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    coded = col.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _group_codes(qrows, crows, group: str | None):
    """Numbers of the group values on both sides, equal for equal values; a null is a value of its own."""
    if group is None:
        return None, None
    q, c = qrows.column(group), crows.column(group)
    if q.type == c.type:
        codes = _codes_of(pa.chunked_array([x for side in (q, c) for x in (side.chunks if isinstance(side, pa.ChunkedArray) else [side])],
                                           type=q.type))[0]
    else:
        codes = pd.factorize(pd.concat([q.to_pandas(), c.to_pandas()], ignore_index=True), use_na_sentinel=False)[0]
    return codes[:len(q)], codes[len(q):]


def _distinct_rows(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct rows of matrices laid side by side, and each row's number among them."""
    flat = np.ascontiguousarray(np.hstack([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1) for p in parts if p.size]))
    rows = flat.view(np.dtype((np.void, flat.shape[1]))).ravel()
    _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
    return first, inverse


def _nearest(qid, qx, qc, qg, cid, cx, cc, cg, k, exclude_self, spec, match, counter=None, cap=None):
    """(query row, case row, d2, rounded d2, rank) of the first k of every query, in chunks of bounded size.

    Queries that agree in everything but the id are compared once, with one neighbour more where a query may meet
    itself, and the answer is expanded to all of them."""
    random = spec.random_seed is not None
    if not random and len(qid) > 1:
        parts = [qx + 0.0, qc] + ([qg[:, None]] if qg is not None else [])
        if sum(p.size for p in parts):
            first, inverse = _distinct_rows(parts)
            if len(first) * 2 <= len(qid):
                widest = None
                if cap is not None:
                    widest = np.zeros(len(first))
                    np.maximum.at(widest, inverse, cap)
                some = _nearest(qid[first], qx[first], qc[first], None if qg is None else qg[first], cid, cx, cc, cg,
                                k + exclude_self, False, spec, match, counter, widest)
                return _expand(some, inverse, qid, cid, k, exclude_self)
    out = []
    if match:
        for g in np.unique(qg):
            mine, theirs = np.flatnonzero(qg == g), np.flatnonzero(cg == g)
            if len(theirs):
                rows, cols, *rest = _nearest(qid[mine], qx[mine], qc[mine], None, cid[theirs], cx[theirs], cc[theirs],
                                             None, k, exclude_self, spec, False, counter,
                                             None if cap is None else cap[mine])
                out.append((mine[rows], theirs[cols], *rest))
    else:
        step = max(1, _CHUNK_ELEMS // max(1, len(cid)))
        for at in range(0, len(qid), step):
            sl = slice(at, at + step)
            if counter is not None:
                counter.add(len(qid[sl]) * len(cid))
            rows, cols, d2 = _candidates(qid[sl], qx[sl], qc[sl], cid, cx, cc, k, exclude_self, spec,
                                         None if qg is None else qg[sl], cg, None if cap is None else cap[sl])
            rows, cols, d2, key, rank = _select(rows, cols, d2, cid, k, random)
            out.append((rows + at, cols, d2, key, rank))
    if not out:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(float), none.astype(float), none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _expand(some, inverse, qid, cid, k, exclude_self):
    """The answers of distinct queries, given to all queries they stand for."""
    rows, cols, d2, key, _ = some
    order = np.argsort(rows, kind="stable")
    rows, cols, d2, key = rows[order], cols[order], d2[order], key[order]
    n = np.bincount(rows, minlength=int(inverse.max(initial=-1)) + 1)
    begin = np.cumsum(n) - n
    size = n[inverse]
    to = np.repeat(np.arange(len(qid)), size)
    at = np.repeat(begin[inverse] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    if exclude_self:
        other = cid[cols[at]] != qid[to]
        to, at = to[other], at[other]
    size = np.bincount(to, minlength=len(qid))
    rank = np.arange(len(to)) - np.repeat(np.cumsum(size) - size, size) + 1
    good = rank <= k
    to, at = to[good], at[good]
    return to, cols[at], d2[at], key[at], rank[good]


class _Block:
    """Cases of a task as matrices, those of one ``by`` value (and, with ``ring``, one cell) side by side."""

    def __init__(self, rows, width: int, unknown: tuple[int, ...], by: str | None, ring: bool = False):
        label, self.labels = (np.zeros(rows.num_rows, dtype=np.int64), None) if by is None else _codes_of(rows.column(by))
        cell = rows.column("_cell").to_numpy() if ring else np.zeros(rows.num_rows, dtype=np.int64)
        if by is not None or ring:
            order = np.lexsort(([rows.column("_away").to_numpy()] if ring else []) + [cell, label])
            rows, label, cell = rows.take(pa.array(order)), label[order], cell[order]
        self.rows = rows
        self.id, self.x, self.codes = _as_matrix(rows, width, unknown)
        new = np.flatnonzero((np.diff(label) != 0) | (np.diff(cell) != 0)) + 1
        edges = [0, *new.tolist(), rows.num_rows] if rows.num_rows else []
        #: begin, end, number of the ``by`` value, cell
        self.parts = [(i, j, int(label[i]), int(cell[i])) for i, j in zip(edges, edges[1:])]
        self.away = rows.column("_away").to_numpy() if ring else None
        #: for each of ``parts`` its cases in strips, or None
        self.strips: list = [None] * len(self.parts)

    def sort_in_strips(self, least: int) -> "_Block":
        from casediff.operators.knn_strips import Strips
        self.strips = [Strips.of(self.id[i:j], self.x[i:j], self.codes[i:j], least) for i, j, _, _ in self.parts]
        return self


def _top_k(qrows, block: _Block, k, exclude_self, spec, width, group=None, match=False, counter=None):
    """(query row, case row, label, d2, rounded d2, rank): the first k of every query in a block, per ``by`` value."""
    q = _as_matrix(qrows, width, spec.unknown())
    qg, cg = _group_codes(qrows, block.rows, group)
    found = []
    for (i, j, label, _), strips in zip(block.parts, block.strips, strict=True):
        of = None if cg is None else cg[i:j]
        if strips is not None:
            rows, cols, *rest = strips.nearest(*q, qg, of, k, exclude_self, spec, counter)
        else:
            rows, cols, *rest = _nearest(*q, qg, block.id[i:j], block.x[i:j], block.codes[i:j], of,
                                         k, exclude_self, spec, match, counter)
        found.append((rows, cols + i, np.full(len(rows), label), *rest))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(float), none.astype(float), none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _final(d2: np.ndarray, spec: DistanceSpec) -> np.ndarray:
    if spec.random_seed is not None:
        return d2
    return d2 / 2.0 if spec.final == "half" else np.sqrt(d2)


def _pandas(col) -> pd.Series:
    """An Arrow column for pandas; whole numbers stay whole beside nulls."""
    return col.to_pandas(integer_object_nulls=True)


def _batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


# --------------------------------------------------------------------------
# Blocks of cases and the queries that meet them
# --------------------------------------------------------------------------


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder with a number of its own for each row, ``_row``."""
    path = scratch_path(df.sparkSession, name)
    df = df.withColumn("_row", F.monotonically_increasing_id())
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def meet(q: DataFrame, c: DataFrame, keys: list[str], n: int, task, schema: T.StructType) -> DataFrame:
    """Queries and cases of equal ``keys``: ``task`` is ``(prepare, ask)``; ``prepare(table)`` gets the cases of a key,
    ``ask(block or None, batch)`` the queries of the key, a batch at a time, and yields batches of ``schema``.

    With ``_part`` as the key, a number below ``n``, each key is a partition (beyond ``_MAX_TASKS`` several are)."""
    prepare, ask = task
    n = max(1, min(n, _MAX_TASKS))
    both = c.withColumn("_side", F.lit(0)).unionByName(q.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    both = both.repartitionById(n, F.col("_part")) if keys == ["_part"] else both.repartition(n, *keys)
    both = both.sortWithinPartitions(*keys, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cases, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            sorted_by = [batch.column(x).to_numpy() for x in (*keys, "_side")]
            begin = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)])
            for i, j in zip(begin, np.r_[begin[1:], batch.num_rows], strict=True):
                key = tuple(int(x[i]) for x in sorted_by[:-1])
                if key != current:
                    current, cases, block = key, [], None
                part = batch.slice(i, j - i)
                if sorted_by[-1][i] == 0:
                    cases.append(part)
                    continue
                if cases:
                    block, cases = prepare(pa.Table.from_batches(cases)), []
                for at in range(0, part.num_rows, _ASKED_ROWS):
                    yield from ask(block, part.slice(at, _ASKED_ROWS))

    return both.mapInArrow(run, schema)


def asked_columns(q: DataFrame, spec: DistanceSpec, group: str | None) -> list[str]:
    """What comparing needs of a query."""
    return ["_row", "id", "x", *(["codes"] if spec.tables else []), *([group] if group else [])]


def compared_columns(c: DataFrame, spec: DistanceSpec, by: str | None, group: str | None) -> list[str]:
    """What comparing needs of a case."""
    return list(dict.fromkeys(asked_columns(c, spec, group) + ([by] if by is not None else [])))


def found_schema(schema: T.StructType, by: str | None) -> T.StructType:
    """Candidates as tasks emit them: ids, distances and the row numbers of both sides."""
    long, double = T.LongType(), T.DoubleType()
    return T.StructType([T.StructField("query_id", long), T.StructField("neighbour_id", long),
                         *([schema[by]] if by is not None else []), T.StructField("dist", double),
                         T.StructField("d2r", double), T.StructField("_q", long), T.StructField("_c", long)])


def found_batches(qrows, block: _Block, rows, cols, label, d2, key, spec: DistanceSpec, by: str | None) -> Iterator[pa.RecordBatch]:
    names = ["query_id", "neighbour_id", *([by] if by is not None else []), "dist", "d2r", "_q", "_c"]
    qid, qrow = _ids(qrows.column("id")), qrows.column("_row").to_numpy()
    crow = block.rows.column("_row").to_numpy()
    for i in range(0, len(rows), _OUT_ROWS * 4):
        sl = slice(i, i + _OUT_ROWS * 4)
        r, c = rows[sl], cols[sl]
        yield _batch(names, [qid[r], block.id[c], *([block.labels.take(pa.array(label[sl]))] if by is not None else []),
                             _final(d2[sl], spec), key[sl], qrow[r], crow[c]])


def plain_task(k, exclude_self, spec, by, group, match, width, counter=None, strips: int | None = None):
    """The task of :func:`meet` that finds the first k of all cases of a block.

    ``strips``: blocks of so many cases are sorted, and only what may be near is compared (see
    :mod:`casediff.operators.knn_strips`); else all pairs are."""
    def prepare(rows):
        block = _Block(rows, width, spec.unknown(), by)
        return block if strips is None else block.sort_in_strips(strips)

    def ask(block, qrows):
        if block is not None:
            rows, cols, label, d2, key, _ = _top_k(qrows, block, k, exclude_self, spec, width, group, match, counter)
            yield from found_batches(qrows, block, rows, cols, label, d2, key, spec, by)

    return prepare, ask


def best_of(cand: DataFrame, q: DataFrame, c: DataFrame, schema: T.StructType, by: str | None, k: int, carry, keep,
            store: bool = False, query: str = "query_id") -> DataFrame:
    """The first k of the candidates of every ``query`` (an id, or ``_q``: a row) with their columns of both sides.

    ``store`` writes the neighbours to the scratch folder, so that later reads compare nothing again."""
    w = Window.partitionBy(query, *([F.col(f"`{by}`")] if by is not None else [])).orderBy("d2r", "neighbour_id", "_q", "_c")
    out = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if store:
        path = scratch_path(q.sparkSession, "knn-neighbours")
        out.write.parquet(path)
        out = q.sparkSession.read.schema(out.schema).parquet(path)
    if carry:
        out = out.join(c.select(F.col("_row").alias("_c"), *[F.col(f"`{src}`").alias(name) for name, src in carry]), "_c")
    if keep:
        out = out.join(q.select(F.col("_row").alias("_q"), *[F.col(f"`{src}`").alias(name) for name, src in keep]), "_q")
    return out.select(*[F.col(f"`{f.name}`") for f in schema.fields])


# --------------------------------------------------------------------------
# Spark operator
# --------------------------------------------------------------------------


def _out_schema(queries: DataFrame, cases: DataFrame, by, carry, keep) -> T.StructType:
    fields = [
        T.StructField("query_id", T.LongType()),
        T.StructField("neighbour_id", T.LongType()),
    ]
    if by is not None:
        fields.append(T.StructField(by, cases.schema[by].dataType))
    fields += [
        T.StructField("rank", T.IntegerType()),
        T.StructField("dist", T.DoubleType()),
        T.StructField("d2r", T.DoubleType()),
    ]
    for name, src in carry:
        fields.append(T.StructField(name, cases.schema[src].dataType))
    for name, src in keep:
        fields.append(T.StructField(name, queries.schema[src].dataType))
    return T.StructType(fields)


def _norm_pairs(cols) -> list[tuple[str, str]]:
    out = []
    for c in cols or ():
        out.append((c, c) if isinstance(c, str) else (c[0], c[1]))
    return out


@dataclass
class BroadcastCases:
    """A case base shipped to the executors once and reused by many joins
    (e.g. every micro-batch of a stream).  Built by :func:`broadcast_cases`."""

    bc: object
    token: str
    n: int
    frame: DataFrame          # the selected case columns (for the output schema)
    width: int
    k: int | None = None      # joins may ask for so many neighbours; None: any number

    def release(self) -> None:
        """Drop the broadcast; joins planned with it can no longer run."""
        self.bc.destroy()


def _row_bytes(df: DataFrame):
    """Size of a row as it is shipped, from its real arrays and strings."""
    total = F.lit(0)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            size = F.when(c.isNotNull(), F.size(c)).otherwise(0) * 8 + 64
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.octet_length(c), F.lit(0)) + 64
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            size = F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 4 + 64
        else:
            size = F.lit(16)
        total = total + size
    return total.cast("bigint")


@dataclass
class _Stats:
    """Rows, bytes, largest row, length of the vectors and (about) the distinct cases of a case base."""

    n: int
    bytes: int
    row_bytes: int
    width: int
    distinct: int


def _alike(c: DataFrame, by: str | None, group: str | None) -> list[str]:
    """Columns in which interchangeable cases agree."""
    return ["x"] + [n for n in ("codes", by, group) if n is not None and n in c.columns]


def _case_stats(c: DataFrame, by: str | None = None, group: str | None = None) -> _Stats:
    """One aggregate over a case base."""
    size = F.when(F.col("x").isNotNull(), F.size("x"))
    alike = F.xxhash64(*[F.col(f"`{n}`") for n in dict.fromkeys(_alike(c, by, group))])
    r = c.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(c)).alias("bytes"), F.max(_row_bytes(c)).alias("row"),
              F.min(size).alias("lo"), F.max(size).alias("hi"), F.approx_count_distinct(alike).alias("distinct")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"case vectors of {r['lo']} to {r['hi']} entries")
    return _Stats(int(r["n"]), int(r["bytes"] or 0), int(r["row"] or 0), int(r["hi"] or 0), int(r["distinct"]))


def distinct_cases(c: DataFrame, k: int, by: str | None = None, group: str | None = None) -> DataFrame:
    """Of the cases that agree in vector, codes, ``by`` and ``group`` the ``k + 1`` with the smallest ids.

    The others are never among a query's first k: as many of smaller id lie at the same distance, and one of them
    at most is the query itself.  Spark keeps k + 1 a task before the shuffle, so a vector that a third of the
    rows share makes no hot task."""
    w = Window.partitionBy(*[F.col(f"`{n}`") for n in dict.fromkeys(_alike(c, by, group))]).orderBy("id")
    return c.withColumn("_copy", F.row_number().over(w)).where(F.col("_copy") <= k + 1).drop("_copy")


def _fewer_cases(c: DataFrame, k: int, stats: _Stats, by: str | None, group: str | None) -> tuple[DataFrame, int]:
    """The case base by the dictionary where that halves it at least, and (about) its rows."""
    rows = (stats.distinct + stats.distinct // 10 + 1) * (k + 1)
    if stats.n < _MIN_DICTIONARY or rows * 2 > stats.n:
        return c, stats.n
    return distinct_cases(c, k, by, group), rows


def _collect_within(c: DataFrame, stats: _Stats, rows: int, limit: int) -> pa.Table | None:
    """The case base on the driver, or None if it may have more than ``limit`` bytes.

    All ``stats.n`` rows fit, or no more rows are asked for than fit at the size of the largest."""
    if rows >= stats.n:
        return c.toArrow() if stats.bytes <= limit else None
    most = limit // max(stats.row_bytes, 1)
    if rows > most:
        return None
    found = c.limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def _ship(spark, rows: pa.Table, c: DataFrame, width: int, k: int | None = None) -> "BroadcastCases":
    """One Arrow stream for all executors."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return BroadcastCases(spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex, rows.num_rows, c, width, k)


def broadcast_cases(cases: DataFrame, *, by: str | None = None,
                    carry: Sequence[str | tuple[str, str]] = (),
                    broadcast_bytes: int | None = None, k: int | None = None) -> BroadcastCases:
    """Check the size of a case base and broadcast it once.

    ``k``: the joins will ask for so many neighbours at most, under a distance (not a random order); copies of a
    vector that cannot be among them stay out."""
    spark = cases.sparkSession
    has_codes = "codes" in cases.columns
    ccols = ["id", "x"] + (["codes"] if has_codes else [])
    if by is not None and by not in ccols:
        ccols.append(by)
    ccols += [src for _, src in _norm_pairs(carry) if src not in ccols]
    c = cases.select(*ccols)
    if broadcast_bytes is None:
        broadcast_bytes = int(spark.conf.get("casediff.knn.broadcastBytes", str(32 << 20)))
    stats = _case_stats(c, by)
    fewer, rows = _fewer_cases(c, k, stats, by, None) if k else (c, stats.n)
    found = _collect_within(fewer, stats, rows, broadcast_bytes)
    if found is None:
        raise ValueError(f"case base of ~{stats.bytes} bytes exceeds the broadcast bound {broadcast_bytes}")
    return _ship(spark, found, c, stats.width, k if rows < stats.n else None)


def knn_join(
    queries: DataFrame,
    cases: "DataFrame | BroadcastCases",
    k: int,
    *,
    exclude_self: bool = False,
    spec: DistanceSpec = EUCLIDEAN,
    by: str | None = None,
    carry: Sequence[str | tuple[str, str]] = (),
    keep: Sequence[str | tuple[str, str]] = (),
    strategy: str = "auto",
    tile_rows: int | None = None,
    tile_bytes: int = 32 << 20,
    broadcast_bytes: int | None = None,
    seed: int = 17,
    exclude_group: str | None = None,
    match_group: str | None = None,
    counter=None,
) -> DataFrame:
    """Exact top-k neighbours of every query among ``cases``.

    ``exclude_self`` drops the pair whose ids are equal (self join, K1; twins
    with a different id stay at distance 0).  ``by`` names a case column
    (e.g. the class) and returns the top-k *per value of that column* for each
    query (K4).  ``carry`` copies case columns to the output (``(new, src)``
    renames), ``keep`` copies query columns.  ``exclude_group`` names a column
    present on both sides: pairs with equal values are never neighbours (one
    join serves every cross-validation fold, E1/E2).  ``match_group``: only
    pairs with equal values are.  ``counter`` is an accumulator that gets the
    number of distances computed.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    if exclude_group and match_group:
        raise ValueError("use exclude_group or match_group, not both")
    match = match_group is not None
    exclude_group = exclude_group or match_group
    carry_p, keep_p = _norm_pairs(carry), _norm_pairs(keep)
    prepared = cases if isinstance(cases, BroadcastCases) else None
    if prepared is not None:
        cases = prepared.frame
    has_codes = "codes" in queries.columns and "codes" in cases.columns
    qcols = ["id", "x"] + (["codes"] if has_codes else [])
    qcols += [s for _, s in keep_p if s not in qcols]
    if exclude_group and exclude_group not in qcols:
        qcols.append(exclude_group)
    ccols = ["id", "x"] + (["codes"] if has_codes else [])
    if exclude_group and exclude_group not in ccols:
        ccols.append(exclude_group)
    if by is not None and by not in ccols:
        ccols.append(by)
    ccols += [s for _, s in carry_p if s not in ccols]
    same_input = queries is cases
    q = queries.select(*qcols)
    c = cases.select(*ccols)
    schema = _out_schema(q, c, by, carry_p, keep_p)
    spark = queries.sparkSession
    if prepared is not None:
        if prepared.k is not None and (k > prepared.k or exclude_group or spec.random_seed is not None):
            raise ValueError(f"the case base was broadcast for up to {prepared.k} nearest neighbours without groups")
        return _broadcast_plan(q, k, exclude_self, spec, by, carry_p, keep_p, prepared.width,
                               schema, exclude_group, match, None, prepared, counter)

    if broadcast_bytes is None:
        broadcast_bytes = int(spark.conf.get("casediff.knn.broadcastBytes", str(32 << 20)))
    stats = _case_stats(c, by, exclude_group)
    row_bytes = math.ceil(stats.bytes / max(stats.n, 1))
    n_queries = stats.n if same_input else None
    rows = stats.n
    if spec.random_seed is None:
        c, rows = _fewer_cases(c, k, stats, by, exclude_group)
    if strategy in ("auto", "broadcast"):
        limit = max(broadcast_bytes, 1) - spec.nbytes()
        found = _collect_within(c, stats, rows, limit)
        if found is not None:
            shipped = _ship(spark, found, c, stats.width)
            return _broadcast_plan(q, k, exclude_self, spec, by, carry_p, keep_p, stats.width, schema,
                                   exclude_group, match, n_queries, shipped, counter)
        if strategy == "broadcast":
            raise ValueError(f"case base of ~{stats.bytes} bytes exceeds the broadcast bound "
                             f"{broadcast_bytes}; use another strategy")
        strategy = "groups" if match else "tiles" if spec.random_seed is not None or not stats.width else "cells"

    # A block holds at most tile_rows rows and about tile_bytes bytes.
    if tile_rows is None:
        tile_rows = int(spark.conf.get("casediff.knn.tileRows", "200000"))
    tile_rows = min(tile_rows, max(64, tile_bytes // max(row_bytes, 1)))
    if n_queries is None:
        n_queries = q.count()
    if strategy in ("cells", "groups"):
        from casediff.operators import knn_cells
        if strategy == "groups":
            if not match:
                raise ValueError("strategy='groups' needs match_group")
            return knn_cells.group_plan(q, c, k, exclude_self, spec, by, carry_p, keep_p, stats.width, schema,
                                        exclude_group, tile_rows, seed, counter)
        if match or spec.random_seed is not None or not stats.width:
            raise ValueError("strategy='cells' needs numeric features and takes neither match_group nor a random order")
        return knn_cells.cell_plan(q, c, k, exclude_self, spec, by, carry_p, keep_p, stats.width, schema,
                                   exclude_group, rows, tile_rows, seed, counter)
    return _tile_plan(q, c, k, exclude_self, spec, by, carry_p, keep_p, stats.width,
                      schema, rows, tile_rows, seed, exclude_group, match, n_queries, counter)


# Distance evaluations a single task should take on before the query side is
# spread over more partitions.
_PAIRS_PER_TASK = 50_000_000
# From this many cases on, repeated vectors are looked for.
_MIN_DICTIONARY = 500
# Partitions of one join at most; beyond that a task takes several tiles in turn.
_MAX_TASKS = 100_000


def _spread_queries(q, n_cases: int, n_queries: int | None = None):
    """Deal the queries out so that a task compares a bounded number of pairs.

    One shuffle of the query side, small against the comparisons; asking the
    plan for its partitions instead would run it.
    """
    if n_queries is None:
        n_queries = q.count()
    parallelism = q.sparkSession.sparkContext.defaultParallelism
    want = max(parallelism, math.ceil(n_queries * max(n_cases, 1) / _PAIRS_PER_TASK))
    return q.repartition(max(1, min(want, n_queries, _MAX_TASKS)), "id")


# Case matrices of broadcast case bases, per Python worker (workers are reused
# across tasks); bounded by the broadcast size check, at most two kept.
_CASE_CACHE: dict = {}


def _cached_cases(bc, token: str, width: int, unknown: tuple[int, ...], by: str | None) -> _Block:
    key = (token, unknown, by)
    hit = _CASE_CACHE.get(key)
    if hit is None:
        while len(_CASE_CACHE) >= 2:
            _CASE_CACHE.pop(next(iter(_CASE_CACHE)))
        with pa.ipc.open_stream(bc.value) as stream:
            hit = _Block(stream.read_all().combine_chunks(), width, unknown, by)
        _CASE_CACHE[key] = hit
    return hit


def _broadcast_plan(q, k, exclude_self, spec, by, carry_p, keep_p, width, schema,
                    group, match, n_queries, prepared, counter=None):
    bc, token = prepared.bc, prepared.token
    q = _spread_queries(q, prepared.n, n_queries)
    columns = ["id", "x", *(["codes"] if spec.tables else []), *([group] if group else [])]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = _cached_cases(bc, token, width, spec.unknown(), by)
        for qpdf in batches:
            if not len(qpdf) or not block.rows.num_rows:
                continue
            qrows = pa.Table.from_pandas(qpdf[columns], preserve_index=False)
            rows, cols, label, d2, key, rank = _top_k(qrows, block, k, exclude_self, spec, width, group, match, counter)
            qid = _ids(qrows.column("id"))
            # The columns of both sides are copied for a few rows at a time.
            for i in range(0, len(rows), _OUT_ROWS):
                sl = slice(i, i + _OUT_ROWS)
                r, c = rows[sl], cols[sl]
                out = {"query_id": qid[r], "neighbour_id": block.id[c]}
                if by is not None:
                    out[by] = _pandas(block.labels.take(pa.array(label[sl])))
                out |= {"rank": rank[sl].astype(np.int32), "dist": _final(d2[sl], spec), "d2r": key[sl]}
                out |= {name: _pandas(block.rows.column(src).take(pa.array(c))) for name, src in carry_p}
                out |= {name: qpdf[src].to_numpy()[r] for name, src in keep_p}
                yield pd.DataFrame(out)

    return q.mapInPandas(score, schema)


def _tile_plan(q, c, k, exclude_self, spec, by, carry_p, keep_p, width, schema,
               n_cases, tile_rows, seed, group, match, n_queries, counter=None):
    parallelism = q.sparkSession.sparkContext.defaultParallelism
    if spec.random_seed is not None:
        width = 0                     # a random order looks at ids only
    q, c = stored(q, "knn-queries"), stored(c, "knn-cases")
    # A cogroup hands its answers back as one frame: that bounds the queries of a tile.
    labels = 1 if by is None else max(1, c.select(F.col(f"`{by}`")).distinct().count())
    q_rows = min(tile_rows, max(64, _TILE_ANSWERS // (k * labels)))
    bc = max(1, math.ceil(n_cases / tile_rows))
    bq = max(1, math.ceil(n_queries / q_rows), math.ceil(parallelism / bc))

    def slim(df):
        return df if width else df.withColumn("x", F.array().cast("array<double>"))

    asked = slim(q.select(*asked_columns(q, spec, group))).withColumn(
        "_qb", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(bq)).cast("int")).withColumn(
        "_cb", F.explode(F.sequence(F.lit(0), F.lit(bc - 1))))
    lying = slim(c.select(*compared_columns(c, spec, by, group))).withColumn(
        "_cb", F.pmod(F.xxhash64("_row", F.lit(seed + 1)), F.lit(bc)).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    found = found_schema(schema, by)
    from casediff.operators import knn_strips
    prepare, ask = plain_task(k, exclude_self, spec, by, group, match, width, counter,
                              knn_strips.MIN_CASES if knn_strips.suits(spec, width, match) else None)

    def tile(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qpdf) and len(cpdf):
            block = prepare(pa.Table.from_pandas(cpdf, preserve_index=False))
            qrows = pa.Table.from_pandas(qpdf, preserve_index=False).combine_chunks()
            for at in range(0, len(qpdf), _ASKED_ROWS):
                out += ask(block, qrows.slice(at, _ASKED_ROWS))
        if not out:
            return pd.DataFrame({f.name: pd.Series(dtype=object) for f in found.fields})
        return pa.Table.from_batches(out).to_pandas()

    # Tiles are light in bytes but heavy in compute: an explicit partition count
    # (one per tile) keeps AQE from coalescing many tiles into one task.  Both
    # sides are hash-partitioned alike, so the cogroup adds no exchange.
    # Block ids are INT on both sides, so equal keys hash alike.
    n_parts = min(max(bq * bc, parallelism), _MAX_TASKS)
    asked, lying = (x.repartition(n_parts, "_qb", "_cb") for x in (asked, lying))
    cand = asked.groupBy("_qb", "_cb").cogroup(lying.groupBy("_qb", "_cb")).applyInPandas(tile, found)
    # with one block of cases a tile has the first k of each of its rows
    return best_of(cand, q, c, schema, by, k, carry_p, keep_p, query="_q" if bc == 1 else "query_id")


def self_knn(cases: DataFrame, k: int, **kw) -> DataFrame:
    """K1: the k nearest *other* cases of every case (self excluded by id)."""
    return knn_join(cases, cases, k, exclude_self=True, **kw)

