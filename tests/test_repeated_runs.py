"""The average over the seeds, besides the row of each."""

from casediff.plans import registry

SF = "/root/testdata/sf0.001"


def test_scores_are_averaged_over_seeds(spark):
    queries = registry.all_queries()
    runs = [r.neg_mae for r in queries["E9_repeated_runs"](spark, SF).collect()]
    mean = queries["E9_mean_of_runs"](spark, SF).collect()
    assert len(mean) == 1 and mean[0].n_runs == len(runs) == 3
    assert abs(mean[0].mean_neg_mae - sum(runs) / 3) < 2e-5 and len(set(runs)) > 1
