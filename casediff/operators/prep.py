"""Table preparation (P1-P16): split, impute, scale, encode, compose.

Statistics are fitted on the training side with one aggregation each and come
back to the driver as a handful of numbers (means, deviations, vocabularies of
nominal columns whose size is checked); the row work stays in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casediff.functions.arrays import onehot, onehot_index
from casediff.schema import CaseSchema

# Largest nominal vocabulary that is collected to encode a column.
MAX_VOCABULARY = 100_000

_M = 2147483647
_A = 48271
_SHIFTS = (15, 13, 16)
_SEED_STEP = 1_000_003


# -- P1-P4 ---------------------------------------------------------------


def rename_by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df.columns = names``."""
    return df.toDF(*names)


def select_roles(df: DataFrame, schema: CaseSchema) -> DataFrame:
    """Keep id, features and target."""
    return df.select(schema.id, *schema.features, schema.target)


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``subset``."""
    return df.dropna(subset=list(subset))


def range_filter(df: DataFrame, col: str, lo=None, hi=None, *, hi_inclusive=False) -> DataFrame:
    """``lo <= col < hi`` (or ``<= hi``)."""
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= F.lit(lo))
    if hi is not None:
        cond = cond & ((c <= F.lit(hi)) if hi_inclusive else (c < F.lit(hi)))
    return df.where(cond)


# -- P5, P6: seeded order and split ----------------------------------------


def seeded_hash(id_col: str | Column, seed: int = 0) -> Column:
    """Seeded integer hash of an id in ``[0, 2^31 - 1)``.

    Three MINSTD steps with a xor-shift after each: a single step is linear, so
    neighbouring ids would keep their order and their remainders.  Pure integer
    arithmetic, so the SQL oracle computes the same value and it never changes
    with the partitioning.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    x = F.pmod(c.cast("bigint") + F.lit(seed * _SEED_STEP), F.lit(_M))
    for shift in _SHIFTS:
        x = F.pmod(x * F.lit(_A), F.lit(_M))
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return F.pmod(x, F.lit(_M))


def fold_of(id_col: str | Column, n_folds: int, seed: int = 0) -> Column:
    """Fold number in ``[0, n_folds)`` from the seeded hash."""
    return F.pmod(seeded_hash(id_col, seed), F.lit(n_folds)).cast("int")


def seeded_order(df: DataFrame, id_col: str, seed: int = 2) -> DataFrame:
    """P5: deterministic shuffle (sort by the seeded hash, then id)."""
    return df.orderBy(seeded_hash(id_col, seed), F.col(id_col))


def train_test_split(df: DataFrame, id_col: str, train_percent: int = 80,
                     seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Seeded split by hash bucket of the id (stable under repartitioning)."""
    bucket = F.pmod(seeded_hash(id_col, seed), F.lit(100))
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)


# -- P7-P11: fitted statistics ---------------------------------------------


def fit_numeric_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """P7 + P9 in one pass: ``(mean, population std after mean imputation)``.

    Imputed values sit on the mean, so the deviation of the imputed column is
    ``std_pop(non-null) * sqrt(n_non_null / n)``; a zero deviation becomes 1.
    """
    if not cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.var_pop(x).alias(f"v_{c}"),
                 F.count(x).alias(f"n_{c}")]
    row = df.agg(*aggs).first()
    n = row["_n"] or 0
    out = {}
    for c in cols:
        mean = row[f"m_{c}"]
        var = row[f"v_{c}"]
        nn = row[f"n_{c}"] or 0
        if mean is None:
            mean, std = 0.0, 1.0
        else:
            std = (var * nn / n) ** 0.5 if n else 0.0
            if std == 0.0:
                std = 1.0
        out[c] = (float(mean), float(std))
    return out


def nominal_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, n)`` for every nominal column, in one aggregation."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("fv")).select("fv.feature", "fv.value")
    return stacked.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))


def fit_nominal_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[str | None, list[str]]]:
    """P8 + P10: ``(most frequent value, sorted vocabulary)`` per column.

    Most frequent ties go to the smallest value.  The vocabulary size is
    checked before it is collected.
    """
    if not cols:
        return {}
    counts = nominal_counts(df, cols)
    bound = MAX_VOCABULARY * max(1, len(cols))
    rows = counts.limit(bound + 1).collect()        # bounded collect, one pass
    if len(rows) > bound:
        raise ValueError(f"nominal vocabularies hold more than {bound} values; too many to encode")
    out: dict[str, tuple[str | None, list[str]]] = {}
    for c in cols:
        vals = [(r["value"], r["n"]) for r in rows if r["feature"] == c]
        vocab = sorted(v for v, _ in vals)
        mode = min(vals, key=lambda t: (-t[1], t[0]))[0] if vals else None
        out[c] = (mode, vocab)
    return out


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """The most frequent value of each column (ties: the smallest); one row a column reaches the driver,
    whatever the number of values."""
    rows = nominal_counts(df, cols).groupBy("feature").agg(F.min_by("value", F.struct(
        (-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("mode")).collect() if cols else []
    found = {r["feature"]: r["mode"] for r in rows}
    return {c: found.get(c) for c in cols}


def value_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """P11 for any number of labels: ``(value, code)``, the distinct non-null values numbered from 0 in their order.

    The distinct values are dealt out by range and numbered within each range, with the sizes of the ranges before
    added; the driver sees neither values nor numbers.  They are written once, so that ranges and sizes agree."""
    from casediff.session import scratch_path
    spark = df.sparkSession
    n = max(2, spark.sparkContext.defaultParallelism)
    values = df.select(F.col(f"`{col}`").alias("value")).where(F.col("value").isNotNull()).distinct()
    path = scratch_path(spark, "values")
    values.repartitionByRange(n, "value").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(values.withColumn("_part", F.lit(0)).schema).parquet(path)
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    parts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    return dealt.join(F.broadcast(parts), "_part").select("value", (F.col("_before") + place - 1).alias(out))


def encode_by_table(df: DataFrame, col: str, codes: DataFrame, code: str = "code") -> DataFrame:
    """``df`` with the code of its label from ``value_codes``; unknown and null labels get null."""
    table = codes.select(F.col("value").alias("_value"), F.col(code))
    return df.join(table, F.col(f"`{col}`") == F.col("_value"), "left").drop("_value")


def mode_expr(df: DataFrame, col: str) -> DataFrame:
    """P8 as a DataFrame: one row with the most frequent value (ties -> smallest)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(F.col(col), F.struct((-F.col("n")).alias("nn"),
                                                     F.col(col).alias("v"))).alias("mode"))


def label_vocabulary(df: DataFrame, col: str) -> list:
    """Sorted distinct labels (natural order of the column type)."""
    rows = df.select(col).distinct().limit(MAX_VOCABULARY + 1).collect()   # bounded, one pass
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} distinct labels; too many to encode")
    return sorted(r[0] for r in rows if r[0] is not None)


def label_encode(col: str | Column, labels: Sequence) -> Column:
    """Index of the label in the sorted label list (0-based; unknown -> null)."""
    c = F.col(col) if isinstance(col, str) else col
    pos = F.array_position(F.array(*[F.lit(v) for v in labels]), c)
    return F.when(pos > 0, (pos - 1).cast("int"))


# -- P12-P16 ---------------------------------------------------------------


def densify(col: str | Column) -> Column:
    """ML vector (sparse or dense) -> ``ARRAY<DOUBLE>``."""
    return vector_to_array(F.col(col) if isinstance(col, str) else col)


def scale_pixels(col: str | Column) -> Column:
    """Pixel values to [0, 1]."""
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda p: p.cast("double") / F.lit(255.0))


def onehot_label(col: str | Column, n_classes: int) -> Column:
    """Integer label -> one-hot vector of length ``n_classes``."""
    return onehot_index(col, n_classes)


def as_continuous(col: str | Column) -> Column:
    """Label as a continuous target."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")


@dataclass
class FittedPreparation:
    """P7-P12 fitted on a training table; ``transform`` yields case rows."""

    schema: CaseSchema
    numeric_stats: dict[str, tuple[float, float]] = field(default_factory=dict)
    nominal_stats: dict[str, tuple[str | None, list[str]]] = field(default_factory=dict)
    scale: bool = True

    def z(self, c: str) -> Column:
        mean, std = self.numeric_stats[c]
        v = F.coalesce(F.col(c).cast("double"), F.lit(mean))
        return (v - F.lit(mean)) / F.lit(std) if self.scale else v

    def nominal_value(self, c: str) -> Column:
        mode, _ = self.nominal_stats[c]
        return F.coalesce(F.col(c).cast("string"), F.lit(mode))

    def features(self) -> Column:
        """``[z(numeric)..., onehot(nominal)...]`` as ``ARRAY<DOUBLE>``."""
        parts = [F.array(*[self.z(c) for c in self.schema.numeric])] if self.schema.numeric \
            else [F.array().cast("array<double>")]
        for c in self.schema.nominal:
            parts.append(onehot(self.nominal_value(c), self.nominal_stats[c][1]))
        return F.concat(*parts)

    def codes(self) -> Column:
        """Nominal value codes (index in the vocabulary; unknown/null -> size)."""
        out = []
        for c in self.schema.nominal:
            vocab = self.nominal_stats[c][1]
            pos = F.array_position(F.array(*[F.lit(v) for v in vocab]), F.col(c).cast("string")) \
                if vocab else F.lit(0)
            out.append(F.when(pos > 0, pos - 1).otherwise(F.lit(len(vocab))).cast("int"))
        return F.array(*out) if out else F.array().cast("array<int>")

    def transform(self, df: DataFrame, *, with_codes: bool = False,
                  numeric_only_x: bool = False) -> DataFrame:
        s = self.schema
        cols = [F.col(s.id).cast("long").alias("id")]
        if numeric_only_x:
            cols.append(F.array(*[self.z(c) for c in s.numeric]).alias("x") if s.numeric
                        else F.array().cast("array<double>").alias("x"))
        else:
            cols.append(self.features().alias("x"))
        if with_codes:
            cols.append(self.codes().alias("codes"))
        cols.append(F.col(s.target).alias("y"))
        return df.select(*cols)


def fit_preparation(train: DataFrame, schema: CaseSchema, *, scale: bool = True) -> FittedPreparation:
    """Fit mean/mode imputation, standardisation and one-hot vocabularies."""
    return FittedPreparation(
        schema=schema,
        numeric_stats=fit_numeric_stats(train, schema.numeric),
        nominal_stats=fit_nominal_stats(train, schema.nominal),
        scale=scale,
    )
