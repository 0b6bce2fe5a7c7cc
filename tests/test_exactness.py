"""Ranking, votes and seeded splits do not depend on units or on the pattern of ids."""

from conftest import cases
from pyspark.sql import functions as F

from casediff.operators import prep as P
from casediff.operators import vote as V
from casediff.operators.knn import knn_join


def test_rank_of_tiny_and_huge_distances(spark):
    for unit in (1e-9, 1e-6, 1.0, 1e7):
        c = cases(spark, [(1, [2 * unit, 0.0], 0), (2, [1.5 * unit, 0.0], 0), (3, [unit, 0.0], 0)])
        q = cases(spark, [(10, [0.0, 0.0], 0)])
        for strategy in ("broadcast", "tiles"):
            got = knn_join(q, c, 3, strategy=strategy).orderBy("rank").collect()
            assert [r.neighbour_id for r in got] == [3, 2, 1], (unit, strategy)


def test_weighted_votes_of_far_neighbours(spark):
    for unit in (1e-6, 1.0, 3e6):
        pairs = spark.createDataFrame([(1, 1, 1.0 * unit, "b"), (1, 2, 3.0 * unit, "a")],
                                      "query_id bigint, rank int, dist double, y string")
        assert V.knn_weighted_vote(pairs, F.col("y")).first().prediction == "b"
        assert V.inverse_distance_vote(pairs, F.col("y")).first().prediction == "b"


def test_seeded_order_and_split(spark):
    df = spark.range(2000)
    one, two = ([r.id for r in P.seeded_order(df, "id", s).collect()] for s in (1, 2))
    assert sorted(one) == list(range(2000)) and one != two and one != sorted(one)
    rising = sum(a < b for a, b in zip(one, one[1:], strict=False))
    assert 850 < rising < 1150
    fold = df.select("id", P.fold_of("id", 10).alias("f"))
    per = fold.groupBy((F.col("id") % 10).alias("r")).agg(F.countDistinct("f").alias("n")).collect()
    assert all(r.n == 10 for r in per)
    train, test = P.train_test_split(df, "id", 80, 2)
    assert 0.75 * 2000 < train.count() < 0.85 * 2000 and train.count() + test.count() == 2000
