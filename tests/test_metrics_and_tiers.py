"""Metric operators on small hand-computed vectors, and the tier cut points."""

import pytest
from pyspark.sql import functions as F

from vantage.functions.tiers import TIER_LABELS, assess_model, ratio_band, score_tier, versatility_rating
from vantage.operators import metrics as M
from vantage.operators.model import stratified_split


def _df(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, prediction int")


def test_confusion_and_prf(spark):
    df = _df(spark, [(1, 0.9, 1), (1, 0.4, 0), (0, 0.8, 1), (0, 0.1, 0), (0, 0.2, 0)])
    r = M.precision_recall_f1(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 1, 1)
    assert r.precision == pytest.approx(0.5) and r.recall == pytest.approx(0.5) and r.f1 == pytest.approx(0.5)


def test_zero_division_is_zero(spark):
    r = M.precision_recall_f1(_df(spark, [(0, 0.1, 0), (1, 0.2, 0)])).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_roc_auc_with_ties(spark):
    # positives 0.8, 0.5 ; negatives 0.5, 0.2 -> pairs: (0.8>0.5)=1, (0.8>0.2)=1, (0.5=0.5)=0.5, (0.5>0.2)=1 -> 3.5/4
    df = _df(spark, [(1, 0.8, 1), (1, 0.5, 1), (0, 0.5, 1), (0, 0.2, 0)])
    assert M.roc_auc(df).first().roc_auc == pytest.approx(0.875)


def test_roc_auc_one_class_is_null(spark):
    assert M.roc_auc(_df(spark, [(1, 0.8, 1), (1, 0.5, 1)])).first().roc_auc is None


def test_pr_curve_and_best_threshold(spark):
    df = _df(spark, [(1, 0.9, 1), (0, 0.7, 1), (1, 0.6, 1), (0, 0.2, 0)])
    c = {r.threshold: r for r in M.pr_curve(df).collect()}
    assert c[0.9].precision == pytest.approx(1.0) and c[0.9].recall == pytest.approx(0.5)
    assert c[0.6].precision == pytest.approx(2 / 3) and c[0.6].recall == pytest.approx(1.0)
    best = M.best_threshold(M.pr_curve(df)).first()
    assert best.threshold == pytest.approx(0.6) and best.f1 == pytest.approx(0.8)


def test_classification_report_lines(spark):
    df = _df(spark, [(1, 0.9, 1), (1, 0.4, 0), (0, 0.8, 1), (0, 0.1, 0), (0, 0.2, 0)])
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    assert rep["accuracy"].f1 == pytest.approx(0.6) and rep["accuracy"].support == 5
    assert rep["0"].precision == pytest.approx(2 / 3) and rep["0"].recall == pytest.approx(2 / 3)
    assert rep["weighted avg"].f1 == pytest.approx((2 / 3) * 3 / 5 + 0.5 * 2 / 5)


def test_class_distribution_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "is_mega_streamer int")
    r = M.class_distribution(df).first()
    assert r.n_positive == 0 and r.imbalance_ratio == float("inf") and r.positive_percentage == 0.0


def test_tiers_lower_bound_inclusive(spark):
    df = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.2,), (0.19999,), (None,)], "p double")
    got = [r.t for r in df.select(score_tier("p").alias("t")).collect()]
    assert got[:5] == [TIER_LABELS[0], TIER_LABELS[1], TIER_LABELS[2], TIER_LABELS[3], TIER_LABELS[4]]
    assert got[5] == TIER_LABELS[4]  # NULL falls through like the CASE ELSE


def test_assessment_and_bands(spark):
    df = spark.createDataFrame([(0.6, 0.5), (0.5, 0.4), (0.1, 0.3), (0.29, 0.29)], "p double, r double")
    assert [r.a for r in df.select(assess_model("p", "r").alias("a")).collect()] == ["EXCELLENT", "GOOD", "MODERATE", "POOR"]
    b = spark.createDataFrame([(0.51,), (0.5,), (0.1,), (0.09,)], "x double").select(ratio_band("x").alias("b"))
    assert [r.b for r in b.collect()] == ["high", "medium", "medium", "low"]
    v = spark.createDataFrame([(0.49,), (0.99,), (1.0,), (None,)], "sd double").select(versatility_rating("sd").alias("v"))
    assert [r.v for r in v.collect()] == ["HIGHLY VERSATILE", "VERSATILE", "GAME-DEPENDENT", "GAME-DEPENDENT"]


def test_stratified_split_is_exact_per_class(spark):
    df = spark.range(1000).select(F.col("id").alias("streamer_id"), (F.col("id") % 10 == 0).cast("int").alias("is_mega_streamer"))
    s = stratified_split(df, test_fraction=0.2, seed=42, buckets=16)
    got = {(r[0], r[1]): r[2] for r in s.groupBy("is_mega_streamer", "is_test").count().collect()}
    assert got[(1, True)] == 20 and got[(1, False)] == 80
    assert got[(0, True)] == 180 and got[(0, False)] == 720
    again = stratified_split(df, test_fraction=0.2, seed=42, buckets=16).filter("is_test").select("streamer_id")
    assert again.exceptAll(s.filter("is_test").select("streamer_id")).count() == 0  # deterministic by seed


def test_split_without_strata(spark):
    """M6: a class of one row cannot be stratified; the split is then over all rows."""
    from vantage.operators.model import split_train_test

    rows = [(k, 1 if k == 7 else 0) for k in range(50)]
    df = spark.createDataFrame(rows, "streamer_id long, is_mega_streamer int")
    s = split_train_test(df)
    assert s.columns == ["streamer_id", "is_mega_streamer", "is_test"]
    assert s.filter("is_test").count() == 10 and s.count() == 50
    both = spark.createDataFrame([(k, k % 2) for k in range(50)], "streamer_id long, is_mega_streamer int")
    assert [r["count"] for r in split_train_test(both).filter("is_test").groupBy("is_mega_streamer").count().collect()] == [5, 5]
    # a test set smaller than the number of classes
    few = spark.createDataFrame([(k, k % 2) for k in range(4)], "streamer_id long, is_mega_streamer int")
    assert split_train_test(few).filter("is_test").count() == 1
    assert split_train_test(df.limit(0)).count() == 0
