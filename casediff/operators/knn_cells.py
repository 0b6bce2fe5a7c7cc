"""Large exact kNN joins that leave out what cannot be near.

Cells
-----
Pivots (centres of a bounded sample of the cases) split the cases into cells; a
case knows its distance to its pivot.  The numeric part of every distance here is
a metric, and nominal features only add to it, so for a query ``q``, a pivot ``p``
and a case ``s`` of its cell ``|d(q,p) - d(s,p)| <= d(q,s)``.

1. Cases are assigned, cells counted.  Neighbouring cells share a block of up to
   ``block_rows`` cases; a larger cell is several blocks, dealt out by a hash of the
   row.  The driver gets one row a cell: number of cases, nearest and farthest
   distance to the pivot.
2. Every query meets a probe of its own cell: ``PROBE_ROWS`` cases, chosen by a hash.
   The k-th distance found is a radius within which its neighbours lie.
3. It then visits the blocks with a cell whose ring of distances meets its own within
   that radius, and in a block only cases of these rings are compared, exactly those
   that the radius does not rule out.
4. Each query's candidates of all blocks are ranked once more.

A case with a missing feature has no such bound: these cases form a cell that all
queries visit, and a query with a missing feature visits all blocks.  A query
without k cases in its probe (per class with ``by``) has no radius and visits all.
Partitions follow the queries that visit a block, in chunks of ``block_rows`` (smaller
ones while there are fewer than two for a core); the cases of a block are copied once
a chunk, and the queries of a chunk reach the task as a stream of Arrow batches.

Groups
------
With ``match_group`` both sides meet by group: small groups whole, and large ones
in blocks of ``block_rows`` on each side (query blocks small enough for all cores).  No pair of different groups is formed.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casediff.operators import knn
from casediff.session import scratch_path

#: Pivots at most, sampled cases for each, and rounds in which they move to their cells' means.
MAX_PIVOTS, SAMPLED, ROUNDS = 1024, 16, 4
#: Cells wanted for each block of cases.
CELLS_PER_BLOCK = 4
#: Cases of its own cell that a query meets first.
PROBE_ROWS = 4096
#: Queries whose rings are cut out of a block together.
RING = 256
MISSING = -1


def _to_pivots(x: np.ndarray, pivots: np.ndarray, numeric: str) -> np.ndarray:
    """Numeric distances of the rows to all pivots, summed feature by feature."""
    out = np.zeros((len(x), len(pivots)))
    for j in range(x.shape[1]):
        diff = np.abs(x[:, j, None] - pivots[None, :, j])
        if numeric == "clip":
            diff = np.minimum(diff, 1.0)
        out += diff * diff
    return np.sqrt(out)


def choose_pivots(c: DataFrame, n: int, width: int, numeric: str, seed: int) -> np.ndarray:
    """``n`` centres of a sample of ``SAMPLED * n`` complete cases, the first by a hash of the id."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (c.where(F.col("x").isNotNull() & finite).select("x", F.xxhash64("id", F.lit(seed)).alias("h"))
            .orderBy("h").limit(SAMPLED * n).collect())
    sample = np.array([r["x"] for r in rows], dtype=float).reshape(len(rows), width)
    sample = np.unique(sample, axis=0)
    pivots = sample[np.random.default_rng(seed).permutation(len(sample))[:n]]
    for _ in range(ROUNDS):
        if not len(pivots):
            break
        near = _nearest_pivot(sample, pivots, numeric)[0]
        count = np.bincount(near, minlength=len(pivots))
        sums = np.stack([np.bincount(near, sample[:, j], len(pivots)) for j in range(width)], axis=1)
        pivots = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], pivots)
    return pivots


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray, numeric: str) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest pivot and its distance, in chunks; ``MISSING`` for rows that lack a feature."""
    near, dist = np.full(len(x), MISSING), np.zeros(len(x))
    whole = np.flatnonzero(~np.isnan(x).any(axis=1)) if len(pivots) else np.empty(0, dtype=np.int64)
    step = max(1, knn._CHUNK_ELEMS // max(1, len(pivots)))
    for i in range(0, len(whole), step):
        part = whole[i:i + step]
        d = _to_pivots(x[part], pivots, numeric)
        near[part] = d.argmin(axis=1)
        dist[part] = d[np.arange(len(part)), near[part]]
    return near, dist


def _with(df: DataFrame, add, *fields: T.StructField) -> DataFrame:
    """``df`` with columns that ``add`` computes from a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = [pa.array(x) for x in add(batch)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in fields]])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def _int(name: str) -> T.StructField:
    return T.StructField(name, T.IntegerType())


def _meet(q: DataFrame, c: DataFrame, keys: list[str], n: int, task, schema) -> DataFrame:
    """Both sides by ``keys`` in ``n`` pinned partitions."""
    return knn.meet(q, c, keys, n, task, schema)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the scratch folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(values, index):
    """Entry ``index`` (from 0) of a list of whole numbers, as a column."""
    return F.get(F.expr(f"array({', '.join(str(int(v)) for v in values)})"), index)


def _dealt(row, parts, seed: int):
    """A number below ``parts`` by a hash of the row."""
    return F.pmod(F.xxhash64(row, F.lit(seed)), parts).cast("int")


def _chunks(n: dict, block_rows: int, parallelism: int) -> dict:
    """Chunks of the queries of each key: of ``block_rows`` at most, and two for a core where they have rows enough."""
    least = math.ceil(2 * parallelism / max(1, len(n)))
    return {x: max(math.ceil(m / block_rows), min(least, math.ceil(m / knn._ASKED_ROWS))) for x, m in n.items()}


def _blocks(cells: dict, pivots: np.ndarray, block_rows: int) -> list[tuple[list[int], int]]:
    """Cells in bundles of up to ``block_rows`` cases, and the blocks of each bundle (several for one large cell only)."""
    out = [([MISSING], math.ceil(cells[MISSING]["n"] / block_rows))] if MISSING in cells else []
    left = sorted(x for x in cells if x != MISSING)
    at, some, rows = None, [], 0
    while left:
        # the next cell is the nearest one
        at = left[0] if at is None else left[int(((pivots[left] - pivots[at]) ** 2).sum(axis=1).argmin())]
        left.remove(at)
        n = cells[at]["n"]
        if some and rows + n > block_rows:
            out.append((some, 1))
            some, rows = [], 0
        if n > block_rows:
            out.append(([at], math.ceil(n / block_rows)))
        else:
            some.append(at)
            rows += n
    return [*out, (some, 1)] if some else out


def cell_plan(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, spec, by, carry, keep, width: int,
              schema: T.StructType, group: str | None, n_cases: int, block_rows: int, seed: int, counter=None) -> DataFrame:
    parallelism = q.sparkSession.sparkContext.defaultParallelism
    ring, probe_rows = RING, PROBE_ROWS
    cases = knn.stored(c, "knn-cases")
    wanted = max(1, min(MAX_PIVOTS, max(parallelism, CELLS_PER_BLOCK * math.ceil(n_cases / block_rows)),
                        n_cases // (4 * (k + 1)) + 1))
    pivots = choose_pivots(cases, wanted, width, spec.numeric, seed)

    def place(batch):
        near, dist = _nearest_pivot(knn._stack(batch.column("x"), width), pivots, spec.numeric)
        return near.astype(np.int32), dist

    placed = _kept(_with(cases.select(*knn.compared_columns(cases, spec, by, group)), place, _int("_cell"),
                         T.StructField("_away", T.DoubleType())), "knn-cells")
    cells = {r["_cell"]: r for r in placed.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("_away").alias("lo"), F.max("_away").alias("hi")).collect()}
    kept = np.array(sorted(x for x in cells if x != MISSING), dtype=np.int64)
    labels = None
    if by is not None:
        labels = cases.select(F.col(f"`{by}`")).distinct().count()

    # -- the probe: a radius for every query
    def own(batch):
        near, _ = _nearest_pivot(knn._stack(batch.column("x"), width), pivots[kept], spec.numeric)
        return (np.where(near == MISSING, MISSING, kept[near] if len(kept) else MISSING).astype(np.int32),)

    queries = _kept(_with(q.withColumn("_row", F.monotonically_increasing_id()), own, _int("_cell")), "knn-queries")
    columns = knn.asked_columns(queries, spec, group)
    per_cell = {r["_cell"]: r["n"] for r in queries.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    chunks = _chunks(per_cell, block_rows, parallelism)
    # cells count from MISSING, so the place of a cell in a list is its number + 1
    every = range(MISSING, len(pivots))
    n_chunks = [chunks.get(x, 0) for x in every]
    first = np.cumsum([0, *n_chunks])[:-1]
    spot = F.col("_cell") - MISSING
    asked = queries.select(*columns, (_at(first, spot) + _dealt("_row", _at(n_chunks, spot), seed + 1)).alias("_part"))
    share = [0 if x == MISSING or x not in cells else min(1 << 31, math.ceil((1 << 31) * probe_rows / cells[x]["n"])) for x in every]
    probes = placed.where(F.pmod(F.xxhash64("_row", F.lit(seed + 2)), F.lit(1 << 31)) < _at(share, spot)).where(_at(n_chunks, spot) > 0)
    probes = probes.select(*knn.compared_columns(cases, spec, by, group), F.explode(F.sequence(
        _at(first, spot), _at(first, spot) + _at(n_chunks, spot) - 1)).alias("_part"))

    bundles = _blocks(cells, pivots, block_rows)
    low, high = (np.array([cells[int(x)][name] for x in kept], dtype=float) for name in ("lo", "hi"))
    belongs = np.zeros((len(kept), len(bundles)), dtype=np.float32)
    for i, (some, _) in enumerate(bundles):
        belongs[np.isin(kept, some), i] = 1
    always = np.array([some == [MISSING] for some, _ in bundles], dtype=bool)

    def visits(x, r):
        """For each query which bundles it visits."""
        d = _to_pivots(x, pivots[kept], spec.numeric)
        # a missing feature makes d NaN: such a query is ruled out nowhere
        return (_met(d, r[:, None], low[None, :], high[None, :]).astype(np.float32) @ belongs > 0) | always[None, :]

    reached = T.StructType([*[queries.schema[x] for x in columns], T.StructField("_radius", T.DoubleType()),
                            T.StructField("_to", T.ArrayType(T.IntegerType()))])

    def prepare_probe(rows):
        return knn._Block(rows, width, spec.unknown(), by)

    def probe(block, batch):
        radius = np.full(batch.num_rows, np.inf)
        if block is not None:
            rows, _, _, _, d2r, rank = knn._top_k(batch, block, k, exclude_self, spec, width, group, False, counter)
            last = rank == k
            worst, n = np.zeros(batch.num_rows), np.bincount(rows[last], minlength=batch.num_rows)
            np.maximum.at(worst, rows[last], d2r[last])
            # with classes, every class must have shown k cases
            sure = n == (1 if labels is None else labels)
            radius[sure] = np.sqrt(worst[sure])
        to = visits(knn._stack(batch.column("x"), width), radius)
        ends = np.r_[0, np.cumsum(to.sum(axis=1))].astype(np.int32)
        to = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(to)[1].astype(np.int32)))
        yield knn._batch(reached.names, [*[batch.column(x) for x in columns], radius, to])

    n_probe = sum(n_chunks)
    seen = _kept(_meet(asked, probes, ["_part"], max(n_probe, 1), (prepare_probe, probe), reached), "knn-radii")

    # -- the visits: as many rows of the driver as there are bundles
    visiting = seen.withColumn("_bundle", F.explode("_to")).drop("_to")
    visited = {r["_bundle"]: r["n"] for r in visiting.groupBy("_bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
    visited = _chunks(visited, block_rows, parallelism)
    # the parts of a bundle: each of its blocks with each chunk of its queries
    n_blocks = [b for _, b in bundles]
    n_chunks = [visited.get(i, 0) for i in range(len(bundles))]
    first = np.cumsum([0, *[b * n for b, n in zip(n_blocks, n_chunks, strict=True)]])
    n_parts, first = int(first[-1]), first[:-1]
    of_cell = {x: i for i, (some, _) in enumerate(bundles) for x in some}
    bundle = F.col("_bundle")
    base, n_b, n_c = _at(first, bundle), _at(n_blocks, bundle), _at(n_chunks, bundle)
    visiting = visiting.withColumn("_chunk", _dealt("_row", n_c, seed + 3))
    visiting = visiting.withColumn("_block", F.explode(F.sequence(F.lit(0), n_b - 1)))
    visiting = visiting.withColumn("_part", base + F.col("_block") * n_c + F.col("_chunk")).drop("_bundle", "_chunk", "_block")
    lying = placed.withColumn("_bundle", _at([of_cell.get(x, -1) for x in every], spot)).where(n_c > 0)
    lying = lying.withColumn("_block", _dealt("_row", n_b, seed + 4))
    lying = lying.withColumn("_part", F.explode(F.sequence(base + F.col("_block") * n_c, base + F.col("_block") * n_c + n_c - 1)))
    lying = lying.drop("_bundle", "_block")

    def prepare(rows):
        return knn._Block(rows, width, spec.unknown(), by, ring=True)

    def compare(block, batch):
        if block is None:
            return
        qid, qx, qc = knn._as_matrix(batch, width, spec.unknown())
        qg, cg = knn._group_codes(batch, block.rows, group)
        radius = batch.column("_radius").to_numpy()
        cap = radius * radius * (1 + 1e-9)
        found = []
        for i, j, label, cell in block.parts:
            away = block.away[i:j]
            if cell == MISSING:
                slices = [(np.arange(len(qid)), 0, j - i)]
            else:
                d = _to_pivots(qx, pivots[cell:cell + 1], spec.numeric)[:, 0]
                mine = np.flatnonzero(_met(d, radius, away[0], away[-1]))
                reach = _wider(radius[mine], d[mine], away[-1])
                begin, end = np.where(np.isnan(d[mine]), -np.inf, d[mine] - reach), np.where(np.isnan(d[mine]), np.inf, d[mine] + reach)
                order = np.lexsort((end, begin))
                slices = []
                for at in range(0, len(order), ring):
                    some = order[at:at + ring]
                    slices.append((mine[some], int(np.searchsorted(away, begin[some].min(), side="left")),
                                   int(np.searchsorted(away, end[some].max(), side="right"))))
            for some, lo, hi in slices:
                if lo < hi:
                    part = slice(i + lo, i + hi)
                    rows, cols, d2, key, _ = knn._nearest(
                        qid[some], qx[some], qc[some], None if qg is None else qg[some], block.id[part], block.x[part],
                        block.codes[part], None if cg is None else cg[part], k, exclude_self, spec, False, counter, cap[some])
                    found.append((some[rows], cols + i + lo, np.full(len(rows), label), d2, key))
        if found:
            rows, cols, label, d2, key = (np.concatenate(x) for x in zip(*found, strict=True))
            # the first k of the block, of all its cells
            order = np.lexsort((block.id[cols], key, label, rows))
            rows, cols, label, d2, key = (x[order] for x in (rows, cols, label, d2, key))
            start = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(label) != 0)])[:len(rows)]
            near = np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)])) < k
            yield from knn.found_batches(batch, block, rows[near], cols[near], label[near], d2[near], key[near], spec, by)

    cand = _meet(visiting, lying, ["_part"], max(n_parts, 1), (prepare, compare), knn.found_schema(schema, by))
    return knn.best_of(cand, queries, cases, schema, by, k, carry, keep, store=True)


def _wider(radius: np.ndarray, d: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A radius with room for rounding: ranks go by 12 digits of d squared, and sums of squares are inexact."""
    return radius * (1 + 1e-9) + 1e-11 * (np.abs(np.nan_to_num(d)) + other)


def _met(d, radius, low, high) -> np.ndarray:
    """Whether a cell's ring meets the query's; a NaN of a missing feature rules nothing out."""
    reach = _wider(radius, d, high)
    return ~((d - reach > high) | (d + reach < low))


def group_plan(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, spec, by, carry, keep, width: int,
               schema: T.StructType, group: str, block_rows: int, seed: int, counter=None) -> DataFrame:
    """Neighbours within groups: both sides by (group, query block, case block)."""
    parallelism = q.sparkSession.sparkContext.defaultParallelism
    q, c = knn.stored(q, "knn-queries"), knn.stored(c, "knn-cases")
    n_queries, n_cases = q.count(), c.count()
    # small tables are cut finer, so that all cores have a part
    q_rows = min(block_rows, max(knn._ASKED_ROWS, math.ceil(n_queries / (2 * parallelism))))
    key = F.xxhash64(F.col(f"`{group}`"))

    def sizes(df, rows):
        """Groups of more than a block, by the hash of their value: as many as rows / block_rows at most."""
        n = df.groupBy(key.alias("_g")).agg(F.count(F.lit(1)).alias("n"))
        return n.where(F.col("n") > rows).select("_g", F.ceil(F.col("n") / rows).cast("int").alias("n"))

    large_q, large_c = (F.broadcast(sizes(x, rows).withColumnRenamed("n", name))
                        for x, rows, name in ((q, q_rows, "_nq"), (c, block_rows, "_nc")))

    def dealt(df, columns, mine, own, other, salt):
        df = df.select(*columns).withColumn("_g", key).join(large_q, "_g", "left").join(large_c, "_g", "left")
        df = df.fillna(1, ["_nq", "_nc"])
        df = df.withColumn(own, F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.col(mine)).cast("int"))
        others = "_nc" if mine == "_nq" else "_nq"
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_nq", "_nc")

    n = max(2 * parallelism, math.ceil(n_queries / q_rows) * math.ceil(n_cases / block_rows))
    cand = _meet(dealt(q, knn.asked_columns(q, spec, group), "_nq", "_qb", "_cb", 1),
                 dealt(c, knn.compared_columns(c, spec, by, group), "_nc", "_cb", "_qb", 2), ["_g", "_qb", "_cb"], n,
                 knn.plain_task(k, exclude_self, spec, by, group, True, width, counter), knn.found_schema(schema, by))
    return knn.best_of(cand, q, c, schema, by, k, carry, keep, store=True)
