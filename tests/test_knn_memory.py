"""What a task of a neighbour join holds: small batches of answers, no vectors among the candidates, right rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casediff.operators import knn, knn_cells
from casediff.operators.knn import knn_join
from casediff.plans import implicit as I

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())),
                       T.StructField("y", T.IntegerType())])


def points(n, dim=8, seed=3, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, [float(v) for v in rng.normal(size=dim)], int(rng.integers(0, 4))) for i in range(n)]


def brute(queries, cases, k, exclude_self=False, by=False):
    x = np.array([c[1] for c in cases])
    out = []
    for qid, v, _ in queries:
        d2 = knn._digits(((x - np.array(v)) ** 2).sum(axis=1))
        seen = {}
        for j in sorted(range(len(cases)), key=lambda j: (d2[j], cases[j][0])):
            if exclude_self and cases[j][0] == qid:
                continue
            some = seen.setdefault(cases[j][2] if by else 0, [])
            if len(some) < k:
                some.append(cases[j][0])
                out.append((qid, cases[j][0], len(some)))
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r.neighbour_id, r["rank"]) for r in df.collect())


def test_broadcast_answers_leave_in_small_batches(spark, monkeypatch):
    """2,000 queries with 4 classes and 3 neighbours: 24,000 answers with two vectors each, never in one frame."""
    got = {}

    class Asked:
        def mapInPandas(self, run, schema):
            got["run"] = run
            return self

    monkeypatch.setattr(knn, "_spread_queries", lambda *a: Asked())
    queries, cases = points(2000), points(100, seed=4, first=5000)
    q, c = (spark.createDataFrame(r, SCHEMA) for r in (queries, cases))
    knn_join(q, c, 3, by="y", keep=[("q_x", "x")], carry=[("n_x", "x")], strategy="broadcast")
    frames = list(got["run"](iter([q.toArrow().to_pandas()])))
    assert sum(len(f) for f in frames) == 2000 * 4 * 3
    assert max(len(f) for f in frames) <= knn._OUT_ROWS < 2000 * 4 * 3
    where = {i: x for i, x, _ in queries + cases}
    for r in frames[-1].head(50).to_dict("records"):
        assert list(r["q_x"]) == where[r["query_id"]] and list(r["n_x"]) == where[r["neighbour_id"]]


def test_queries_reach_a_block_batch_by_batch(spark):
    """The cases of a key are prepared once; its queries come in several batches."""
    side = "_part int, _row bigint, id bigint"
    cases = spark.createDataFrame([(p, i, i) for p in (0, 1) for i in range(5)], side)
    queries = spark.createDataFrame([(p, i, i) for p in (0, 1, 2) for i in range(5000)], side)

    def ask(block, batch):
        n = 0 if block is None else block.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([n])], names=["n", "cases"])

    got = knn.meet(queries, cases, ["_part"], 3, (lambda table: table, ask), "n bigint, cases bigint").collect()
    assert sum(r.n for r in got) == 15000 and max(r.n for r in got) <= knn._ASKED_ROWS
    assert sum(r.n for r in got if r.cases == 5) == 10000 and sum(r.n for r in got if r.cases == 0) == 5000


@pytest.mark.parametrize("by", [None, "y"])
def test_cells_send_no_vectors_and_find_the_same(spark, monkeypatch, by):
    """Eight dimensions: the radius of the probe selects among matrix products."""
    monkeypatch.setattr(knn_cells, "PROBE_ROWS", 60)
    seen = []
    real = knn_cells._meet
    monkeypatch.setattr(knn_cells, "_meet", lambda q, c, keys, n, f, s: (seen.append(s.names), real(q, c, keys, n, f, s))[1])
    data = points(900)
    d = spark.createDataFrame(data, SCHEMA)
    got = knn_join(d, d, 3, exclude_self=True, by=by, keep=[("q_x", "x"), ("q_y", "y")], carry=[("n_x", "x")],
                   strategy="cells", tile_rows=150).cache()
    assert rows(got) == brute(data, data, 3, True, by is not None)
    assert "n_x" not in seen[1] and "q_x" not in seen[1]
    where = {i: (x, y) for i, x, y in data}
    for r in got.collect():
        assert (r.q_x, r.q_y) == where[r.query_id] and r.n_x == where[r.neighbour_id][0]
    got.unpersist()


@pytest.mark.parametrize("strategy, tile_rows", [("broadcast", None), ("tiles", 200), ("tiles", 40), ("cells", 40)])
def test_rows_with_equal_ids_keep_their_own_columns(spark, strategy, tile_rows):
    """Two query rows of one id: one block of cases answers each row, several blocks the id, with the columns of its rows."""
    cases = points(120)
    queries = points(10, seed=9, first=1000) + points(10, seed=10, first=1000)
    q, c = (spark.createDataFrame(r, SCHEMA) for r in (queries, cases))
    got = knn_join(q, c, 2, keep=[("q_x", "x")], carry=[("n_x", "x")], strategy=strategy, tile_rows=tile_rows).collect()
    if tile_rows != 40:
        assert sorted((r.query_id, r.neighbour_id, r["rank"]) for r in got) == brute(queries, cases, 2)
    assert len(got) == (20 if tile_rows == 40 else 40)
    where = {i: x for i, x, _ in cases}
    for r in got:
        assert r.n_x == where[r.neighbour_id] and (r.query_id, r.q_x) in [(i, x) for i, x, _ in queries]
        assert abs(r.dist - np.linalg.norm(np.array(r.q_x) - np.array(r.n_x))) < 1e-9


def test_nearest_pair_reads_its_pairs_from_one_written_table(spark, monkeypatch):
    """The join of pairs reads its sides several times, so they are no neighbour joins any more."""
    plans = []
    real = I.knn_join
    monkeypatch.setattr(I, "knn_join", lambda q, c, *a, **kw: (plans.append((q, c)), real(q, c, *a, **kw))[1])
    d = spark.createDataFrame(points(200), SCHEMA)
    out = I.predict_nearest_pair(d.where(F.col("id") % 5 > 0), d.where(F.col("id") % 5 == 0)).collect()
    assert len(out) == 40
    for side in plans[-1]:
        assert "MapIn" not in side._jdf.queryExecution().optimizedPlan().toString()
