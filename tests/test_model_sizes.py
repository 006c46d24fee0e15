"""The registered model queries do the whole stated job."""

import pytest
from pyspark.sql import functions as F

from thermalframe.operators import models
from thermalframe.plans import queries as q

SF = "/root/testdata/sf0.001"
GBT = {"trees": 300, "depth": 8, "rate": 0.05, "subsample": 0.8, "columns": 0.8, "l1": 0.1, "l2": 1.0}
FOREST = {"numTrees": 100, "maxDepth": 15}


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, size", [
    ("fit_gbt", GBT), ("fit_gbt_early_stop", GBT), ("cv_temporal_refit", GBT), ("fit_random_forest", FOREST),
    ("compare_models", FOREST), ("importance_long", FOREST), ("importance_mean_trees", FOREST)])
def test_queries_fit_the_stated_sizes(spark, monkeypatch, name, size):
    fit = models.fit_per_target

    def record(train, features, targets, estimator, extra=()):
        made = estimator(targets[0])
        if isinstance(made, models.Linear) and name == "compare_models":       # its first two models are linear
            return fit(train, features, targets, estimator, extra)
        of = (lambda k: getattr(made, k)) if isinstance(made, models.Boosting) else made.getOrDefault
        assert list(targets) == q.TARGETS and {k: of(k) for k in size} == size
        raise Seen
    monkeypatch.setattr(models, "fit_per_target", record)
    monkeypatch.setattr(models, "fit_boosted", lambda rows, features, targets, made, roles: record(rows, features, targets, lambda t: made))
    with pytest.raises(Seen):
        q.QUERIES[name](spark, SF)


def test_mean_importance_is_that_of_the_models(spark):
    long = q.importance_long(spark, SF, trees=3, depth=3).groupBy("feature").agg(F.avg("importance").alias("m"))
    want = {r["feature"]: r["m"] for r in long.collect()}
    got = {r["feature"]: r["mean"] for r in q.importance_mean_trees(spark, SF, trees=3, depth=3).collect()}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1.0)


def test_stream_scores_are_those_of_the_batch(spark):
    live = {r["sample_id"]: r for r in q.stream_score(spark, SF).collect()}
    batch = {r["sample_id"]: r for r in q.predict_batch(spark, SF).collect()}
    assert live and set(live) == set(batch)
    for i, r in batch.items():
        assert [live[i][f"{t}_pred"] for t in q.TARGETS] == pytest.approx([r[t] for t in q.TARGETS], rel=1e-9)
    raw = {r["sample_id"]: r for r in q.bounded(spark, SF).collect()}
    for i, r in live.items():
        assert r["Q_thermal"] == pytest.approx(raw[i]["UCWF"] / 60 * 4.186 * (raw[i]["UCWIT"] - r["UCWOT_pred"]), rel=1e-9)
