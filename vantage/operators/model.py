"""The classifier (M3-M17): preprocessing stages, split, weights, boosted trees,
evaluation, importances and batch scoring, all on Spark ML.

Preprocessing follows the reference's semantics exactly: the median imputer
uses the interpolated median (Spark's ``Imputer`` picks an approximate element)
and the scaler divides by the population standard deviation (Spark's
``StandardScaler`` uses the sample one and does not centre by default).
"""

from __future__ import annotations

import logging

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.functions.tiers import score_tier
from vantage.session import reliable_checkpoint
from vantage.operators import metrics as Mx
from vantage.operators.quantiles import exact_percentiles
from vantage.operators.ml import FEATURES, LABEL, RAW_FEATURES, add_tune_in_ratio

log = logging.getLogger(__name__)

# Boosted-tree settings of the reference model.
GBT_PARAMS = dict(maxIter=200, maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
MIN_POSITIVES = 5
ROWS_PER_PARTITION = 25_000  # rows of the training set that one task passes over
WARN_POSITIVES = 10


# ------------------------------------------------------------------ M3 assemble


def require_columns(df: DataFrame, cols=RAW_FEATURES) -> None:
    """D1 / M3 metadata-only check: every required feature column is present."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")


# ------------------------------------------------------- M4 / M5 custom stages


class _Values(Params):
    values = Param(Params._dummy(), "values", "fitted per-column values", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted per-column scales", typeConverter=TypeConverters.toListFloat)


class ExactMedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M4 fill NULL/NaN with the column's exact (interpolated) median of the fit data."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ExactMedianImputerModel":
        cols = self.getInputCols()
        found = exact_percentiles(df, cols, [0.5])
        meds = [found[c][0] if found[c][0] is not None else 0.0 for c in cols]
        return ExactMedianImputerModel(inputCols=cols, outputCols=self.getOutputCols(), values=meds)


class ExactMedianImputerModel(Model, HasInputCols, HasOutputCols, _Values, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.values))
        new = {}
        for c, o, v in fills:
            x = F.col(c).cast("double")
            new[o] = F.when(x.isNull() | F.isnan(x), F.lit(v)).otherwise(x)
        return df.withColumns(new)


class PopulationScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """M5 z-score with the population standard deviation (a constant column keeps scale 1)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        scales = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(cols))]
        return PopulationScalerModel(inputCols=cols, outputCols=self.getOutputCols(), values=means, scales=scales)


class PopulationScalerModel(Model, HasInputCols, HasOutputCols, _Values, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, values=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.values), self.getOrDefault(self.scales))
        return df.withColumns({o: (F.col(c) - m) / s for c, o, m, s in parts})


def build_pipeline(features=FEATURES, label: str = "label", weight: str = "weight", **gbt) -> Pipeline:
    """M9 impute -> scale -> assemble -> boosted trees (class-weighted)."""
    params = dict(GBT_PARAMS)
    params.update(gbt)
    imputed = [f"_imp_{c}" for c in features]
    scaled = [f"_z_{c}" for c in features]
    return Pipeline(
        stages=[
            ExactMedianImputer(inputCols=list(features), outputCols=imputed),
            PopulationScaler(inputCols=imputed, outputCols=scaled),
            VectorAssembler(inputCols=scaled, outputCol="features", handleInvalid="keep"),
            GBTClassifier(featuresCol="features", labelCol=label, weightCol=weight, **params),
        ]
    )


# ------------------------------------------------------------- M6 / M7 split


def stratified_split(df: DataFrame, label: str = LABEL, key: str = "streamer_id", test_fraction: float = 0.2, seed: int = 42, buckets: int = 4096) -> DataFrame:
    """M6 exact stratified split: per class the first ``round(n * test_fraction)``
    rows in a seeded pseudo-random order (hash bucket, then hash of ``key``) form
    the test set (``is_test``).

    Rows are counted per (class, hash bucket); cumulative bucket counts (a tiny
    table) locate the boundary bucket, and only that bucket is ranked row by
    row, so no class is ever sorted as a whole."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    x = df.withColumn("_h", h).withColumn("_bk", F.pmod(F.col("_h"), F.lit(buckets)))
    counts = x.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    wl = Window.partitionBy(label).orderBy("_bk")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_n", F.sum("_c").over(Window.partitionBy(label)))
    counts = counts.withColumn("_k", F.round(F.col("_n") * F.lit(test_fraction), 0).cast("long"))
    j = x.join(counts.select(label, "_bk", "_before", "_c", "_k"), [label, "_bk"])
    edge = (F.col("_before") < F.col("_k")) & (F.col("_before") + F.col("_c") > F.col("_k"))
    rank = F.row_number().over(Window.partitionBy(label, "_bk").orderBy("_h", key))
    inside = j.filter(~edge).withColumn("is_test", F.col("_before") < F.col("_k"))
    ranked = j.filter(edge).withColumn("is_test", F.col("_before") + rank <= F.col("_k"))
    j = inside.unionByName(ranked)
    return j.drop("_h", "_bk", "_before", "_c", "_k")


def split_train_test(df: DataFrame, label: str = LABEL, key: str = "streamer_id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """M6 stratified by class, or over all rows alike when that cannot be: a class has a
    single row, or the test set would have fewer rows than there are classes."""
    sizes = [r["count"] for r in df.groupBy(label).count().collect()]  # a row per class
    if sizes and (min(sizes) < 2 or round(sum(sizes) * test_fraction) < len(sizes)):
        log.warning("classes of %s rows cannot be stratified; splitting without", sizes)
        return stratified_split(df.withColumn("_all", F.lit(0)), "_all", key, test_fraction, seed).drop("_all")
    return stratified_split(df, label, key, test_fraction, seed)


def with_class_weight(train: DataFrame, label: str = LABEL, weight: str = "weight") -> tuple[DataFrame, float]:
    """M7 positives weigh n_negative / n_positive of the training split (1 without positives)."""
    row = train.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    w = (row["n0"] / row["n1"]) if row["n1"] else 1.0
    return train.withColumn(weight, F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0))), w


# ---------------------------------------------------------- M10-M17 training


def check_distribution(df: DataFrame, label: str = LABEL) -> dict:
    """M10 refuse an empty set or fewer than 5 positives; warn under 10."""
    row = Mx.class_distribution(df, label).first().asDict()
    if row["total"] == 0:
        raise ValueError("no training rows")
    if row["n_positive"] < MIN_POSITIVES:
        raise ValueError(f"{row['n_positive']} positive rows are too few to fit on (least: {MIN_POSITIVES})")
    if row["n_positive"] < WARN_POSITIVES:
        log.warning("very few positive samples (%s)", row["n_positive"])
    return row


def train(training: DataFrame, test_fraction: float = 0.2, seed: int = 42, label: str = LABEL, partitions: int | None = None, **gbt) -> dict:
    """M17 end to end: guard, exact stratified split, class weight, fit, predict.

    Every level of every tree is a pass over all rows, so the rows are dealt over
    ``partitions`` tasks, by default one per ``ROWS_PER_PARTITION``.  The row sampling of
    the trees depends on the partitioning: the number follows from the table alone, never
    from the cluster, so a rerun samples the same rows."""
    require_columns(training, RAW_FEATURES)
    data = add_tune_in_ratio(training, overwrite=False).withColumn("label", F.col(label).cast("double"))
    dist = check_distribution(data, label)
    # cut the lineage once: the split feeds both the fit and the evaluation
    split = reliable_checkpoint(split_train_test(data, label, test_fraction=test_fraction, seed=seed))
    partitions = partitions or -(-dist["total"] // ROWS_PER_PARTITION)
    split = split.repartition(partitions, "streamer_id").sortWithinPartitions("streamer_id")
    tr, te = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    tr, w = with_class_weight(tr, label)
    model = build_pipeline(**gbt).fit(tr)
    preds = reliable_checkpoint(predict(model, te))  # read by every metric
    return {"model": model, "predictions": preds, "class_weight": w, "distribution": dist}


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions with the class-1 probability as ``score``."""
    out = model.transform(add_tune_in_ratio(df, overwrite=False))
    helpers = [c for c in out.columns if c.startswith("_imp_") or c.startswith("_z_")]
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", *helpers)


def evaluate(predictions: DataFrame, label: str = "label") -> dict:
    """M11 metric DataFrames for the test predictions."""
    from vantage.functions.tiers import assess_model

    prf = Mx.precision_recall_f1(predictions, label, "prediction")
    return {
        "report": Mx.classification_report(predictions, label, "prediction"),
        "class1": prf.withColumn("assessment", assess_model("precision", "recall")),
        "roc_auc": Mx.roc_auc(predictions, label, "score"),
        "pr_curve": Mx.pr_curve(predictions, label, "score"),
    }


def feature_importance(model: PipelineModel, features=FEATURES) -> list[tuple[str, float]]:
    """M12 (feature, importance) sorted descending (a handful of numbers)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, imp), key=lambda t: -t[1])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M13 batch scoring: prediction, class-1 probability, tier, best first."""
    require_columns(df, RAW_FEATURES)
    p = predict(model, df)
    return p.select(
        *[c for c in df.columns if c != "tune_in_ratio"],
        "tune_in_ratio",
        F.col("prediction").cast("int").alias("mega_streamer_prediction"),
        F.col("score").alias("mega_streamer_score"),
        score_tier("score").alias("tier"),
    ).orderBy(F.col("mega_streamer_score").desc(), *[F.col(c) for c in ("streamer_id",) if c in df.columns])


def score_one(model: PipelineModel, spark, record: dict) -> DataFrame:
    """M14 one record through the batch path; the ratio is only added when absent."""
    return score(model, spark.createDataFrame([record]))


def cross_validate(training: DataFrame, grid: dict | None = None, folds: int = 3, seed: int = 42, **gbt):
    """M16 grid search with k-fold CV on class-1 F1."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = add_tune_in_ratio(training, overwrite=False).withColumn("label", F.col(LABEL).cast("double"))
    data, _ = with_class_weight(data, LABEL)
    pipe = build_pipeline(**gbt)
    est = pipe.getStages()[-1]
    grid = grid or {"maxIter": [100, 200, 300], "maxDepth": [4, 6, 8], "stepSize": [0.01, 0.05, 0.1]}
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), values)
    ev = MulticlassClassificationEvaluator(labelCol="label", metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=b.build(), evaluator=ev, numFolds=folds, seed=seed, parallelism=2)
    return cv.fit(data)


def save_model(model: PipelineModel, path: str) -> None:
    """A13 persist the fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A13 load; a path that does not exist is a FileNotFoundError, any other failure
    keeps its own error."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no model is stored at {path}")
    return PipelineModel.load(path)
