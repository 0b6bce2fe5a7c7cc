"""Nominal value distances and mixed metrics (M2-M8).

* VDM (M2): ``d(a, b) = sqrt(sum_c (P(c|a) - P(c|b))^2)``; a value never seen
  contributes 1 per class.
* HVDM (M3): ``sqrt(sum_num (z_a - z_b)^2 + sum_nom vdm^2)``.
* CVDHM value distance (M4): with ``p = P(value | class)``,
  ``sum_c |p_a - p_b| / sum_c (p_a + p_b)`` (0 when the denominator is 0).
* CVDHM per feature (M5): null -> 1; nominal -> M4 (equal values 0, unseen 1);
  numeric -> ``min(1, |a - b|)``.  Case distance: ``sum d^2 / 2`` (M6) or
  ``sqrt(sum d^2)`` (M7).

Lookups are computed with ``groupBy`` counts and equi-joins on the feature
(and class); the pairwise table of a feature has ``V^2`` rows for ``V``
distinct values, so ``V`` is checked before anything is collected for the kNN
kernel.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casediff.operators.knn import DistanceSpec

# Up to so many values of a feature its kernel table is a V x V matrix (8 MiB); more are
# compared by their class profiles.  A full lookup has V^2 rows, which is its output.
MAX_VALUES = 1024
MAX_PAIR_VALUES = 20_000
# Counts (feature, value, class) that the driver gathers for a metric, at most.
MAX_CELLS = 4_000_000


def value_class_counts(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, value, cls, n)`` over all nominal features in one aggregation."""
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                     F.col(f).cast("string").alias("value"))
                            for f in features])).alias("fv"),
        F.col(label).cast("string").alias("cls"))
    return (stacked.select("fv.feature", "fv.value", "cls")
            .where(F.col("value").isNotNull())
            .groupBy("feature", "value", "cls").agg(F.count(F.lit(1)).alias("n")))


def _check_vocabulary(cnt: DataFrame) -> None:
    """Pairs of values grow as V^2: refuse before they are built."""
    sizes = cnt.groupBy("feature").agg(F.countDistinct("value").alias("n")).collect()
    for r in sizes:
        if r["n"] > MAX_PAIR_VALUES:
            raise ValueError(f"nominal feature {r['feature']} has {r['n']} values "
                             f"(> {MAX_PAIR_VALUES}); its lookup of all value pairs would not be bounded")


def _value_pairs(vals: DataFrame) -> DataFrame:
    a = vals.select("feature", F.col("value").alias("v1"), *[F.col(c).alias(c + "_a")
                                                           for c in vals.columns if c not in ("feature", "value")])
    b = vals.select("feature", F.col("value").alias("v2"), *[F.col(c).alias(c + "_b")
                                                           for c in vals.columns if c not in ("feature", "value")])
    return _dealt(a, "v1").join(_dealt(b, None), ["feature", "deal"]).drop("deal")


# Shares into which the work of one feature, or of one feature and class, is dealt.
DEALS = 32


def _dealt(df: DataFrame, by: str | None) -> DataFrame:
    """The left side of a self join on few keys takes one share by its value; the right goes to all."""
    if by is None:
        return df.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALS - 1).cast("bigint"))))
    return df.withColumn("deal", F.pmod(F.xxhash64(by), F.lit(DEALS)))


def vdm_lookup(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """M2: ``(feature, v1, v2, d)`` for every pair of seen values (``d = 0`` on the diagonal).

    ``sum_c (p_a - p_b)^2 = s_a + s_b - 2 sum_c p_a p_b`` with ``s = sum_c p^2``;
    the cross term only needs the classes both values occur with.
    """
    cnt = value_class_counts(df, features, label)
    _check_vocabulary(cnt)
    tot = cnt.groupBy("feature", "value").agg(F.sum("n").alias("nv"))
    p = cnt.join(tot, ["feature", "value"]).select(
        "feature", "value", "cls", (F.col("n") / F.col("nv")).alias("p"))
    s = p.groupBy("feature", "value").agg(F.sum(F.col("p") * F.col("p")).alias("s"))
    pairs = _value_pairs(s)
    pa = p.select("feature", "cls", F.col("value").alias("v1"), F.col("p").alias("pa"))
    pb = p.select("feature", "cls", F.col("value").alias("v2"), F.col("p").alias("pb"))
    cross = _dealt(pa, "v1").join(_dealt(pb, None), ["feature", "cls", "deal"]).groupBy("feature", "v1", "v2").agg(
        F.sum(F.col("pa") * F.col("pb")).alias("x"))
    d2 = pairs.join(cross, ["feature", "v1", "v2"], "left").select(
        "feature", "v1", "v2",
        F.when(F.col("v1") == F.col("v2"), F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.col("s_a") + F.col("s_b")
                       - 2.0 * F.coalesce(F.col("x"), F.lit(0.0)))).alias("d2"))
    return d2.select("feature", "v1", "v2", F.sqrt("d2").alias("d"))


def cvdhm_lookup(df: DataFrame, features: Sequence[str], label: str, sparse: bool = False) -> DataFrame:
    """M4 / M8: ``(feature, v1, v2, d)`` with ``p = P(value | class)``; equal values -> 0.

    ``sum_c |p_a - p_b| = t_a + t_b - 2 sum_c min(p_a, p_b)`` with
    ``t = sum_c p``; the min term only needs shared classes.  ``sparse``: only the pairs that
    share a class, for a lookup that takes 1 for all others (which is their distance);
    it has no bound on the number of values.
    """
    cnt = value_class_counts(df, features, label)
    if not sparse:
        _check_vocabulary(cnt)
    ncls = df.where(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("nc"))
    p = cnt.join(ncls, "cls").select("feature", "value", "cls",
                                     (F.col("n") / F.col("nc")).alias("p"))
    t = p.groupBy("feature", "value").agg(F.sum("p").alias("t"))
    pa = p.select("feature", "cls", F.col("value").alias("v1"), F.col("p").alias("pa"))
    pb = p.select("feature", "cls", F.col("value").alias("v2"), F.col("p").alias("pb"))
    shared = _dealt(pa, "v1").join(_dealt(pb, None), ["feature", "cls", "deal"]).groupBy("feature", "v1", "v2").agg(
        F.sum(F.least("pa", "pb")).alias("m"))
    if sparse:
        of = lambda v, out: t.select("feature", F.col("value").alias(v), F.col("t").alias(out))
        j = shared.join(of("v1", "t_a"), ["feature", "v1"]).join(of("v2", "t_b"), ["feature", "v2"])
    else:
        j = _value_pairs(t).join(shared, ["feature", "v1", "v2"], "left")
    den = F.col("t_a") + F.col("t_b")
    num = den - 2.0 * F.coalesce(F.col("m"), F.lit(0.0))
    return j.select("feature", "v1", "v2",
                    F.when(F.col("v1") == F.col("v2"), F.lit(0.0))
                     .when(den == 0.0, F.lit(0.0))
                     .otherwise(F.greatest(F.lit(0.0), num) / den).alias("d"))


@dataclass
class NominalEncoding:
    """Sorted vocabularies of the nominal features; code ``len(vocab)`` = unknown."""

    features: tuple[str, ...]
    vocabularies: dict[str, list[str]]

    def codes(self) -> Column:
        out = []
        for f in self.features:
            vocab = self.vocabularies[f]
            value = F.col(f).cast("string")
            if len(vocab) <= LITERALS:
                pos = F.array_position(F.array(*[F.lit(v) for v in vocab]), value) if vocab else F.lit(0)
                out.append(F.when(pos > 0, pos - 1).otherwise(F.lit(len(vocab))).cast("int"))
            else:
                out.append(_code_of(vocab)(value))
        return F.array(*out) if out else F.array().cast("array<int>")


# Values of a feature that are written into a plan; more are looked up in Arrow batches.
LITERALS = 256


def _code_of(vocab: list[str]):
    """A column function: the place of a value in the vocabulary, its length for others and nulls."""
    numbers = {v: i for i, v in enumerate(vocab)}

    @F.pandas_udf("int")
    def code(values: pd.Series) -> pd.Series:
        return values.map(numbers).fillna(len(numbers)).astype("int32")

    return code


def _profiles(df: DataFrame, features: Sequence[str], label: str, given: str):
    """Class profiles of the values: ``{feature: (values, number of value, number of class, p)}``, one entry for
    each pair of value and class that occurs, and the number of classes.

    ``given="value"``: ``p = P(c | v)`` (VDM); ``given="class"``: ``p = P(v | c)`` (CVDHM).  The counts are
    bounded by ``MAX_CELLS``, checked while they are read."""
    rows = value_class_counts(df.where(F.col(label).isNotNull()), features, label).limit(MAX_CELLS + 1).collect()
    classes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("cls")).count().limit(
        MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS or len(classes) > MAX_CELLS:
        raise ValueError(f"nominal features have more than {MAX_CELLS} pairs of value and class")
    cidx = {c: i for i, c in enumerate(sorted(r["cls"] for r in classes))}
    class_n = np.zeros(max(len(cidx), 1))
    for r in classes:
        class_n[cidx[r["cls"]]] = r["count"]
    out = {}
    by_feature: dict[str, list] = {f: [] for f in features}
    for r in rows:
        by_feature[r["feature"]].append((r["value"], cidx[r["cls"]], r["n"]))
    for f, cells in by_feature.items():
        values = sorted({v for v, _, _ in cells})
        vidx = {v: i for i, v in enumerate(values)}
        cells.sort(key=lambda t: (vidx[t[0]], t[1]))
        v = np.array([vidx[t[0]] for t in cells], dtype=np.int64)
        c = np.array([t[1] for t in cells], dtype=np.int64)
        n = np.array([t[2] for t in cells], dtype=float)
        total = np.bincount(v, n, len(values))[v] if given == "value" else class_n[c]
        out[f] = (values, v, c, n / np.maximum(total, 1))
    return out, len(cidx)


class ProfileTable:
    """Squared distances of nominal codes from their sparse class profiles, without a table of all pairs.

    ``kind``: ``"vdm"`` ``sum_c (p_a - p_b)^2``, or ``"cvdhm"`` ``(sum_c |p_a - p_b| / sum_c (p_a + p_b))^2``.  Only the
    classes that both codes have need their pairs; what each has alone comes from its sums.  The code after
    the last is unknown and costs ``unknown``; equal codes cost 0."""

    def __init__(self, kind: str, n: int, value: np.ndarray, cls: np.ndarray, p: np.ndarray, unknown: float):
        self.kind, self.n, self.unknown = kind, n, float(unknown)
        self.value, self.cls, self.p = value, cls, p
        self.sums = np.bincount(value, p * p if kind == "vdm" else p, n)
        self.starts = np.searchsorted(value, np.arange(n + 1))
        self.nbytes = value.nbytes + cls.nbytes + p.nbytes + self.sums.nbytes + self.starts.nbytes

    def __len__(self) -> int:
        return self.n + 1

    def _entries(self, codes: np.ndarray):
        """(class, row in ``codes``, p) of the codes' profiles, by class."""
        known = np.flatnonzero(codes < self.n)
        size = self.starts[codes[known] + 1] - self.starts[codes[known]]
        at = np.repeat(self.starts[codes[known]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        row = np.repeat(known, size)
        order = np.argsort(self.cls[at], kind="stable")
        return self.cls[at][order], row[order], self.p[at][order]

    def _finish(self, shared, a, b):
        sa, sb = (np.append(self.sums, 0.0)[x] for x in (a, b))
        both = sa + sb
        d = both - 2.0 * shared
        # what is left of equal profiles is rounding error
        d = np.where(d <= 1e-13 * both, 0.0, d)
        if self.kind == "cvdhm":
            d = np.divide(d, both, out=np.zeros_like(d), where=both != 0) ** 2
        return np.where((a == self.n) | (b == self.n), self.unknown, np.where(a == b, 0.0, d))

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of all pairs of two lists of codes."""
        ua, ia = np.unique(a, return_inverse=True)
        ub, ib = np.unique(b, return_inverse=True)
        ca, ra, pa = self._entries(ua)
        cb, rb, pb = self._entries(ub)
        shared = np.zeros((len(ua), len(ub)))
        for c in np.intersect1d(ca, cb):
            x, y = (slice(*np.searchsorted(of, [c, c + 1])) for of in (ca, cb))
            part = np.multiply.outer(pa[x], pb[y]) if self.kind == "vdm" else np.minimum.outer(pa[x], pb[y])
            shared[np.ix_(ra[x], rb[y])] += part
        return self._finish(shared, ua[:, None], ub[None, :])[ia[:, None], ib[None, :]]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of codes side by side."""
        codes, inverse = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        found = np.array([self.matrix(x[:1], x[1:])[0, 0] for x in codes]) if len(codes) else np.empty(0)
        return found[inverse.reshape(-1)]


def _with_unknown(d2: np.ndarray, unknown: float) -> np.ndarray:
    v = d2.shape[0]
    m = np.full((v + 1, v + 1), float(unknown))
    m[:v, :v] = d2
    return m


def _dense(n_values: int, n_classes: int, v: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.zeros((n_values, n_classes))
    out[v, c] = p
    return out


def hvdm_spec(train: DataFrame, nominal: Sequence[str], label: str):
    """M3: HVDM kernel spec; unseen nominal values cost ``|classes|`` (1 per class)."""
    profiles, n_classes = _profiles(train, nominal, label, given="value")
    tables, vocab = [], {}
    for f in nominal:
        values, v, c, prob = profiles[f]
        vocab[f] = values
        if max(len(values), n_classes) > MAX_VALUES:
            tables.append(ProfileTable("vdm", len(values), v, c, prob, n_classes))
            continue
        p = _dense(len(values), n_classes, v, c, prob)
        d2 = np.zeros((len(values), len(values)))
        for i in range(p.shape[1]):                 # sum over classes, left to right
            diff = p[:, i, None] - p[None, :, i]
            d2 += diff * diff
        tables.append(_with_unknown(d2, n_classes))
    return NominalEncoding(tuple(nominal), vocab), DistanceSpec(numeric="sq", tables=tuple(tables),
                                                                final="sqrt")


def cvdhm_spec(train: DataFrame, nominal: Sequence[str], label: str, final: str = "sqrt"):
    """M6 (``final='half'``) / M7 (``'sqrt'``): CVDHM kernel spec; equal 0, unseen 1."""
    profiles, n_classes = _profiles(train, nominal, label, given="class")
    tables, vocab = [], {}
    for f in nominal:
        values, v, c, prob = profiles[f]
        vocab[f] = values
        if max(len(values), n_classes) > MAX_VALUES:
            tables.append(ProfileTable("cvdhm", len(values), v, c, prob, 1.0))
            continue
        p = _dense(len(values), n_classes, v, c, prob)
        num = np.zeros((len(values), len(values)))
        den = np.zeros((len(values), len(values)))
        for i in range(p.shape[1]):
            num += np.abs(p[:, i, None] - p[None, :, i])
            den += p[:, i, None] + p[None, :, i]
        d = np.divide(num, den, out=np.zeros_like(num), where=den != 0)
        np.fill_diagonal(d, 0.0)
        tables.append(_with_unknown(d * d, 1.0))
    return NominalEncoding(tuple(nominal), vocab), DistanceSpec(numeric="clip", tables=tuple(tables),
                                                                final=final)


def feature_distances(pairs: DataFrame, numeric: Sequence[str], nominal: Sequence[str],
                      lookup: DataFrame) -> DataFrame:
    """M5 per pair and feature: ``(query_id, neighbour_id, feature, d)``.

    ``pairs`` carries the raw feature columns as ``q_<f>`` and ``n_<f>``.
    Numeric: ``min(1, |a - b|)``; nominal: lookup (equal 0, unseen 1); null -> 1.
    """
    parts = []
    for f in numeric:
        a, b = F.col(f"q_{f}"), F.col(f"n_{f}")
        parts.append(F.struct(F.lit(f).alias("feature"), F.lit(None).cast("string").alias("a"),
                              F.lit(None).cast("string").alias("b"),
                              F.when(a.isNull() | b.isNull(), F.lit(1.0))
                               .otherwise(F.least(F.lit(1.0), F.abs(a - b))).alias("num")))
    for f in nominal:
        parts.append(F.struct(F.lit(f).alias("feature"), F.col(f"q_{f}").cast("string").alias("a"),
                              F.col(f"n_{f}").cast("string").alias("b"),
                              F.lit(None).cast("double").alias("num")))
    long = pairs.select("query_id", "neighbour_id", F.explode(F.array(*parts)).alias("e")) \
        .select("query_id", "neighbour_id", "e.*")
    lk = lookup.select("feature", F.col("v1").alias("a"), F.col("v2").alias("b"),
                       F.col("d").alias("lk"))
    # The lookup has up to V^2 rows per feature: Spark picks the join by its size.
    j = long.join(lk, ["feature", "a", "b"], "left")
    d = (F.when(F.col("num").isNotNull(), F.col("num"))
         .when(F.col("a").isNull() | F.col("b").isNull(), F.lit(1.0))
         .when(F.col("a") == F.col("b"), F.lit(0.0))
         .otherwise(F.coalesce(F.col("lk"), F.lit(1.0))))
    return j.select("query_id", "neighbour_id", "feature", d.alias("d"))
