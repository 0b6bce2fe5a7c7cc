"""Tiles with nominal codes: distances counted, results equal to a comparison of all pairs."""

import numpy as np
import pandas as pd
import pytest
from test_knn_cells import TABLE, brute, clusters, frame, result

from casediff.operators import knn, knn_strips
from casediff.operators.knn import DistanceSpec, knn_join
from casediff.operators.vdm import ProfileTable
from casediff.plans import registry_metrics as R


def documents(folder, n, seed=5):
    """``n`` labelled documents with their lengths, 3 languages and 4 sources."""
    rng = np.random.default_rng(seed)
    quality = rng.integers(0, 2, n)
    pd.DataFrame({"doc_id": np.arange(n), "lang": rng.choice(["de", "en", "fr"], n, p=[0.2, 0.5, 0.3]),
                  "source": np.where(rng.random(n) < 0.3, "web", rng.choice(["a", "b", "c"], n)),
                  "n_chars": rng.lognormal(7, 1, n).astype("int64")}).to_parquet(folder / "documents.parquet")
    pd.DataFrame({"doc_id": np.arange(n), "quality": quality}).to_parquet(folder / "labels.parquet")
    return str(folder)


def test_case_distance_root_compares_a_small_part_of_all_pairs(spark, tmp_path, monkeypatch):
    """M7 finds the neighbours that M6 finds from all pairs, and its work grows with the rows, not with their square."""
    real, done = R.knn_join, []
    for n in (6000, 12000):
        sf = tmp_path / str(n)
        sf.mkdir()
        sf = documents(sf, n)
        counter = spark.sparkContext.accumulator(0)
        monkeypatch.setattr(R, "knn_join", lambda *a, **kw: real(*a, **kw, counter=counter))
        root = R.m7_root(spark, sf).collect()
        done.append(counter.value)
        half = R.m6_half(spark, sf).collect()
        places = lambda rows: sorted((r.query_id, r["rank"], r.neighbour_id) for r in rows)
        assert places(root) == places(half) and len(root) > n * 0.2 * 4
        want = {(r.query_id, r["rank"]): np.sqrt(2 * r.dist) for r in half}
        assert max(abs(r.dist - want[r.query_id, r["rank"]]) for r in root) < 2e-3
        assert done[-1] < 0.1 * (0.2 * n) * (0.8 * n)
    assert done[1] < 3 * done[0]


@pytest.mark.parametrize("how", ["self", "query", "missing", "hvdm", "by", "folds", "copies", "one feature"])
def test_tiles_equal_brute_force(spark, monkeypatch, how):
    monkeypatch.setattr(knn_strips, "MIN_CASES", 40)
    dim = 1 if how == "one feature" else 2
    spec = DistanceSpec(numeric="sq" if how == "hvdm" else "clip", tables=(TABLE,))
    scaled = lambda rows: [(i, [None if v is None else v / 8 for v in x], *rest) for i, x, *rest in rows]
    rows = scaled(clusters(700, dim, missing=0.05 if how == "missing" else 0, repeat=9 if how == "copies" else 1))
    asked = rows if how in ("self", "copies") else scaled(clusters(120, dim, 2, missing=0.05 if how == "missing" else 0, first=10_000))
    kw = {"exclude_self": how in ("self", "copies"), "by": "cls" if how == "by" else None,
          "exclude_group": "grp" if how == "folds" else None}
    cases = frame(spark, rows, True)
    queries = cases if asked is rows else frame(spark, asked, True)
    for tile_rows in (1000, 250):
        got = knn_join(queries, cases, 4, spec=spec, strategy="tiles", tile_rows=tile_rows, **kw)
        assert result(got, how == "by") == brute(asked, rows, 4, kw["exclude_self"], spec, how == "by", exclude=how == "folds")


@pytest.mark.parametrize("seed", range(12))
def test_strips_equal_a_full_scan(monkeypatch, seed):
    """Ties, far queries, missing features and codes, several features, small chunks."""
    monkeypatch.setattr(knn, "_CHUNK_ELEMS", [2_000_000, 3000][seed % 2])
    rng = np.random.default_rng(seed)
    n, m, dim, k = 1500, 200, 1 + seed % 3, 1 + seed % 5

    def side(rows):
        x = [rng.normal(size=(rows, dim)), np.round(rng.normal(size=(rows, dim)), 1), rng.standard_t(1.2, (rows, dim)) * 1e6][seed % 3]
        x[rng.random(x.shape) < 0.03] = np.nan
        return rng.permutation(2 * n)[:rows].astype(np.int64), x, rng.integers(0, 4, (rows, 2))

    table = np.round(rng.random((4, 4)), 2)
    profiles = ProfileTable("cvdhm", 3, np.repeat(np.arange(3), 2), np.tile(np.arange(2), 3), rng.random(6), 1.0)
    spec = DistanceSpec(numeric=["clip", "sq"][seed // 3 % 2], tables=(table * (1 - np.eye(4)), profiles))
    (cid, cx, cc), (qid, qx, qc) = side(n), side(m)
    self_join = bool(seed // 2 % 2)
    rows, cols, d2, key, rank = knn_strips.Strips.of(cid, cx, cc, 1).nearest(qid, qx, qc, None, None, k, self_join, spec)
    got = sorted(zip(rows, rank, cid[cols], d2, key, strict=True))
    exact = knn._exact_sq(qx, cx, qc, cc, spec)
    rows, cols = np.nonzero(qid[:, None] != cid[None, :]) if self_join else np.indices(exact.shape).reshape(2, -1)
    rows, cols, d2, key, rank = knn._select(rows, cols, exact[rows, cols], cid, k, False)
    assert got == sorted(zip(rows, rank, cid[cols], d2, key, strict=True))
