"""Boosted-tree pipeline: shape, determinism by seed, separable data, persistence,
scoring output, guards.  (No bit-parity with other learners is expected.)"""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vantage.operators import model as Mo
from vantage.operators.ml import LABEL, RAW_FEATURES


@pytest.fixture(scope="module")
def separable(spark):
    df = spark.range(400).select(F.col("id").alias("streamer_id"))
    pos = (F.col("streamer_id") % 5 == 0)
    cols = {c: (F.col("streamer_id") % 7).cast("double") for c in RAW_FEATURES}
    cols["first_30d_avg_viewers"] = F.when(pos, F.lit(40.0) + F.col("streamer_id") % 3).otherwise(F.lit(10.0) + F.col("streamer_id") % 3)
    cols["first_30d_follower_count"] = F.when(F.col("streamer_id") % 11 == 0, F.lit(None)).otherwise(F.lit(100.0))
    return df.select("streamer_id", *[e.alias(c) for c, e in cols.items()], pos.cast("int").alias(LABEL))


def test_train_evaluate_score_persist(spark, separable):
    res = Mo.train(separable, maxIter=8, maxDepth=3)
    stages = [type(s).__name__ for s in res["model"].stages]
    assert stages == ["ExactMedianImputerModel", "PopulationScalerModel", "VectorAssembler", "GBTClassificationModel"]
    assert res["class_weight"] == pytest.approx(4.0)
    ev = Mo.evaluate(res["predictions"])
    assert ev["roc_auc"].first().roc_auc > 0.95
    c1 = ev["class1"].first()
    assert c1.precision > 0.9 and c1.recall > 0.9 and c1.assessment == "EXCELLENT"
    scored = Mo.score(res["model"], separable.drop(LABEL))
    assert {"mega_streamer_prediction", "mega_streamer_score", "tier", "tune_in_ratio"} <= set(scored.columns)
    top = scored.first()
    assert top.mega_streamer_score >= scored.agg(F.max("mega_streamer_score")).first()[0]
    d = tempfile.mkdtemp(prefix="vantage-test-")
    Mo.save_model(res["model"], os.path.join(d, "m"))
    again = Mo.load_model(os.path.join(d, "m"))
    a = Mo.predict(res["model"], separable).select("streamer_id", "score")
    b = Mo.predict(again, separable).select("streamer_id", "score")
    assert a.exceptAll(b).count() == 0
    imp = Mo.feature_importance(res["model"])
    assert imp[0][0] == "first_30d_avg_viewers" and len(imp) == 9


def test_deterministic_by_seed(spark, separable):
    a = Mo.predict(Mo.train(separable, maxIter=4, maxDepth=2)["model"], separable).select("streamer_id", "score")
    b = Mo.predict(Mo.train(separable, maxIter=4, maxDepth=2)["model"], separable).select("streamer_id", "score")
    assert a.exceptAll(b).count() == 0


def test_guards(spark, separable):
    with pytest.raises(ValueError, match="too few"):
        Mo.train(separable.withColumn(LABEL, F.when(F.col("streamer_id") < 20, F.col(LABEL)).otherwise(0)), maxIter=2)
    with pytest.raises(ValueError, match="lacks"):
        Mo.score(None, separable.drop("first_30d_chat_rate"))
    with pytest.raises(FileNotFoundError):
        Mo.load_model("/nonexistent/model/path")


def test_single_record_keeps_given_ratio(spark, separable):
    res = Mo.train(separable, maxIter=4, maxDepth=2)
    rec = {c: 1.0 for c in RAW_FEATURES}
    rec["tune_in_ratio"] = 123.0
    out = Mo.score_one(res["model"], spark, rec).first()
    assert out.tune_in_ratio == 123.0 and out.tier
    assert out.first_30d_avg_viewers == 1.0  # inputs come back unscaled


def test_cross_validation_small_grid(spark, separable):
    cv = Mo.cross_validate(separable, grid={"maxDepth": [2, 3]}, folds=2, maxIter=3)
    assert len(cv.avgMetrics) == 2


def test_rows_are_dealt_over_tasks(spark, separable, monkeypatch):
    assert Mo.train(separable, maxIter=1, maxDepth=1)["predictions"].rdd.getNumPartitions() == 1
    monkeypatch.setattr(Mo, "ROWS_PER_PARTITION", 150)
    assert Mo.train(separable, maxIter=1, maxDepth=1)["predictions"].rdd.getNumPartitions() == 3
