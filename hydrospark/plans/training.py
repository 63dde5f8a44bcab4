"""Model training, scoring and bookkeeping on Spark ML.

Training runs on the executors (MLlib tree learners aggregate split
statistics per partition) and covers every training row. Scaling
uses population statistics from ``features.scaler_stats`` (the reference
scaler divides by the population std; MLlib's ``StandardScaler`` would use
the sample std).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrospark.operators.features import scaler_stats, split_chronological, split_stratified, standardize
from hydrospark.operators.forest import Forest, fit_forest
from hydrospark.operators.ranking import sample_per_class
from hydrospark.operators.regression import LinearFit, linear_regression
from hydrospark.operators.split_points import table_split_points
from hydrospark.operators.stats import class_balance, regression_metrics

_PART_ROWS = 32_768
_MIN_PARTS = 8
_MAX_PART_ROWS = 1_000_000
# MLlib takes split points from all rows up to this many and from a sample above;
# of (maximal bins)**2 rows if that is more, which must be an int.
_SPLIT_ROWS = 10_000
_MOST_BINS = 46_340


@dataclass
class TrainedClassifier:
    model: PipelineModel | None
    stats: DataFrame | None
    features: list[str]
    metrics: DataFrame  # one row: accuracy, r2_score, mse, samples_used, status, message


def _metrics_row(spark: SparkSession, model_name: str, accuracy, r2, mse, samples, status, message) -> DataFrame:
    schema = ("model_name string, accuracy double, r2_score double, mse double, samples_used int, "
              "status string, message string")
    return spark.createDataFrame([(model_name, accuracy, r2, mse, samples, status, message)], schema)


def _kept(df: DataFrame) -> DataFrame:
    """A one-row table by value, so that nothing stays persisted for it."""
    return df.sparkSession.createDataFrame([df.first()], df.schema)


def _dealt(df: DataFrame, rows: int, id_col: str = "reading_id") -> DataFrame:
    """The rows in no more partitions than make about ``_PART_ROWS`` rows each, or
    ``_MIN_PARTS``, and of those no more than there are cores, unless a partition would
    have over ``_MAX_PART_ROWS``. A tree learner fills the statistics of every open
    node once a partition, so its work is partitions times nodes: the rows must
    not lie in as many pieces as the table they were taken from."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(_MIN_PARTS, min(math.ceil(rows / _PART_ROWS), cores), math.ceil(rows / _MAX_PART_ROWS))
    return df.repartition(parts, id_col) if df.rdd.getNumPartitions() > parts else df


def _fit_trees(learner: RandomForestClassifier | GBTRegressor, df: DataFrame, rows: int,
               feature_cols: list[str]) -> PipelineModel:
    """A tree model fitted on all ``rows`` rows. Where MLlib would sample rows for its
    split points, features are first cut at points taken from all rows, and the learner
    is made to read all rows for the thresholds between them."""
    cols, stages = feature_cols, []
    if rows > _SPLIT_ROWS:
        cols = [f"_bin_{c}" for c in feature_cols]
        edges = [[-math.inf, *p, math.inf] if len(p) else [-math.inf, 0.0, math.inf]  # a constant: one bin
                 for p in table_split_points(df, feature_cols, nearest=True)]
        stages = [Bucketizer(splitsArray=edges, inputCols=feature_cols, outputCols=cols, handleInvalid="keep")]
        learner.setMaxBins(min(_MOST_BINS, math.ceil(math.sqrt(rows)) + 1))
    assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[*stages, assembler, learner]).fit(df)


def train_pump_classifier(features: DataFrame, feature_cols: list[str], label: str = "target",
                          min_samples: int = 50, seed: int = 42, num_trees: int = 100,
                          max_depth: int = 10) -> TrainedClassifier:
    """M7: stratified 80/20 split, population scaling fitted on train,
    random forest with balanced class weights; metrics on the test part:
    accuracy, R^2 of label vs P(ON), MSE of label vs class. Too few samples or
    a single class -> a 'failed' metrics row and no model.

    Split, scaling, class weights, split points, trees and metrics cover all rows.
    One copy of the features and one of the scaled training rows are persisted while
    this runs."""
    spark = features.sparkSession
    features = features.persist()
    try:
        counts = features.groupBy(label).count().collect()  # at most two rows
        n = sum(r["count"] for r in counts)
        if n < min_samples:
            msg = f"Only {n} samples available, need at least {min_samples}" if n else "Insufficient training data"
            return TrainedClassifier(None, None, feature_cols,
                                     _metrics_row(spark, "none", 0.0, 0.0, 0.0, n, "failed", msg))
        if len(counts) < 2 or min(r["count"] for r in counts) < 2:
            msg = "Training failed: the least populated class has too few members"
            return TrainedClassifier(None, None, feature_cols,
                                     _metrics_row(spark, "none", 0.0, 0.0, 0.0, 0, "failed", msg))
        split = split_stratified(features, label, 0.2, seed)
        train = split.filter(~F.col("is_test"))
        test = split.filter(F.col("is_test"))
        stats = _kept(scaler_stats(train, feature_cols))
        balance = class_balance(train, label).select(label, "weight", "n_class").collect()  # a row per class
        rows = sum(r["n_class"] for r in balance)
        weights = spark.createDataFrame([r[:2] for r in balance],
                                        T.StructType([train.schema[label], T.StructField("_w", T.DoubleType())]))
        fit_on = _dealt(standardize(train, stats, feature_cols).join(F.broadcast(weights), label), n).persist()  # <= 2 rows
        rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                    seed=seed, weightCol="_w")
        try:
            model = _fit_trees(rf, fit_on, rows, feature_cols)
        finally:
            fit_on.unpersist()
        scored = score(model, standardize(test, stats, feature_cols))
        # All metrics from one pass over the scored rows.
        m = regression_metrics(scored, label=label, prediction="p_on", clip=False, also=(
            F.avg(F.when(F.col("predicted") == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"),
            F.avg((F.col(label) - F.col("predicted")) ** 2).alias("class_mse")))
        row = _kept(m.select(
            F.lit("Random Forest Classifier").alias("model_name"), "accuracy", F.col("r2").alias("r2_score"),
            F.col("class_mse").alias("mse"),
            F.lit(n).cast("int").alias("samples_used"), F.lit("success").alias("status"),
            F.lit(f"Model trained successfully with {n} samples").alias("message")))
        return TrainedClassifier(model, stats, feature_cols, row)
    finally:
        features.unpersist()


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``p_on`` = P(class 1) and ``predicted`` = p_on >= threshold (or the
    regression value >= threshold for regressors)."""
    out = model.transform(df)
    out = out.drop(*[c for c in out.columns if c.startswith("_bin_")])
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = F.col("prediction")
    return out.withColumn("p_on", p).withColumn("predicted", F.when(F.col("p_on") >= threshold, 1).otherwise(0)) \
        .drop("features", "rawPrediction", "probability", "prediction")


def train_regressor_ensemble(features: DataFrame, feature_cols: list[str], label: str = "target",
                             seed: int = 42, trees: int = 100, max_depth: int = 30) -> tuple[DataFrame, dict]:
    """M8: chronological 80/20 split, scaling fitted on train; random forest,
    gradient boosting and linear regression; predictions clipped to [0, 1];
    MSE and R^2 per model; ``pos`` keeps the listing order for T11 ties.

    Scaling, split points, all three models and the metrics cover all rows; one
    scaled copy of the training rows is persisted beside the one copy of the
    features. The forest (``operators.forest``) has trees of depth 30 at most;
    boosting has depth 3."""
    spark = features.sparkSession
    split = split_chronological(features).persist()
    try:
        train = split.filter(~F.col("is_test"))
        test = split.filter(F.col("is_test"))
        stats = _kept(scaler_stats(train, feature_cols))
        tr = standardize(train, stats, feature_cols)
        te = standardize(test, stats, feature_cols)
        rows = train.count()
        fit_on = _dealt(tr, rows).persist()
        try:
            boosting = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=3, seed=seed)
            models = {"random_forest": fit_forest(fit_on, feature_cols, label, trees, max_depth, seed),
                      "gradient_boosting": _fit_trees(boosting, fit_on, rows, feature_cols)}
        finally:
            fit_on.unpersist()
        models["linear_regression"] = linear_regression(tr, feature_cols, label)
        figures = []
        for pos, (name, model) in enumerate(models.items()):
            pred = te.withColumn("prediction", model.predict()) if isinstance(model, LinearFit) else model.transform(te)
            pred = pred.select(F.col(label).cast("double").alias("label"), "prediction")
            m = regression_metrics(pred, "label", "prediction", clip=True).first()  # one row
            figures.append((pos, name, float(m["mse"] or 0.0), float(m["r2"] or 0.0)))
        return spark.createDataFrame(figures, "pos int, name string, mse double, r2 double"), models
    finally:
        split.unpersist()


def feature_importance(model: PipelineModel | Forest | LinearFit, feature_cols: list[str]) -> DataFrame | None:
    """M9: feature -> importance for tree models (None otherwise)."""
    if isinstance(model, LinearFit):
        return None
    if isinstance(model, Forest):
        imp = model.importances
    else:
        last = model.stages[-1]
        if not hasattr(last, "featureImportances"):
            return None
        imp = last.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(feature_cols, imp)], "feature string, importance double")


def train_health_classifier(rows: DataFrame, seed: int = 42, fit_rows: int = 200_000,
                            max_depth: int = 30) -> PipelineModel:
    """Random forest (100 trees, as deep as MLlib allows) on soil,
    temperature, humidity, pump -> the F9 health label. No split, no metric (as
    in the original). Fitted on at most ``fit_rows`` rows of each label, a sample
    by a hash of the row."""
    content = F.to_json(F.struct("soil", "temperature", "humidity", "pump01"), {"ignoreNullFields": "false"})
    keyed = rows.withColumn("_id", content)
    rows = sample_per_class(keyed, "health", "_id", fit_rows, seed + 1).drop("_id")
    indexer = StringIndexer(inputCol="health", outputCol="health_idx")
    assembler = VectorAssembler(inputCols=["soil", "temperature", "humidity", "pump01"], outputCol="features",
                                handleInvalid="keep")
    rf = RandomForestClassifier(labelCol="health_idx", featuresCol="features", numTrees=100, maxDepth=max_depth, seed=seed)
    return Pipeline(stages=[indexer, assembler, rf]).fit(rows)


def save_model(trained: TrainedClassifier, path: str, trained_at: str) -> DataFrame:
    """Persist the pipeline, the scaler statistics and an info row
    (trained_at, metrics, features) under ``path``."""
    trained.model.write().overwrite().save(f"{path}/model")
    trained.stats.write.mode("overwrite").parquet(f"{path}/scaler")
    info = trained.metrics.select(
        F.lit(trained_at).alias("trained_at"), "model_name", "accuracy", "r2_score", "mse", "samples_used",
        F.lit(len(trained.features)).alias("feature_count"),
        F.array(*[F.lit(c) for c in trained.features]).alias("features"))
    info.write.mode("overwrite").json(f"{path}/info")
    return info


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(pipeline, scaler statistics, info row)."""
    return (PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scaler"),
            spark.read.json(f"{path}/info"))


def training_log_row(metrics: DataFrame, ts, keep: tuple[str, ...] = ()) -> DataFrame:
    """One training-log row per attempt, success or failure. ``keep`` passes
    further columns, such as a device, through."""
    return metrics.select(*keep, F.lit(None).cast("long").alias("id"), ts.alias("ts"), "model_name", "accuracy",
                          "r2_score", "mse", F.col("samples_used").cast("int"), "status", "message")


def model_status(training_log: DataFrame, feature_count: int = 0) -> DataFrame:
    """Newest successful model: accuracy, r2, samples, trained_at and
    ``feature_count`` (of the stored model, see ``save_model``); zeros and
    'Never' when there is none."""
    ok = training_log.filter(F.col("status") == "success")
    best = ok.agg(F.max_by(F.struct("accuracy", "r2_score", "samples_used", "ts"), F.struct("ts", "id")).alias("m"))
    return best.select(
        F.col("m").isNotNull().alias("model_exists"),
        F.coalesce("m.accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("m.r2_score", F.lit(0.0)).alias("r2_score"),
        F.coalesce("m.samples_used", F.lit(0)).alias("samples_used"),
        F.coalesce(F.date_format("m.ts", "yyyy-MM-dd HH:mm:ss"), F.lit("Never")).alias("last_trained"),
        F.when(F.col("m").isNotNull(), feature_count).otherwise(0).alias("feature_count"))


def training_report(metrics: DataFrame, importance: DataFrame | None, trained_at: str) -> DataFrame:
    """One row: training date, model count, best model (T11), empty
    performance metrics, feature importance of the best model."""
    from hydrospark.operators.latest import best_model
    best = best_model(metrics, "r2", "name", "pos")
    cnt = metrics.agg(F.count(F.lit(1)).alias("models_trained"))
    rep = best.crossJoin(cnt).select(
        F.lit(trained_at).alias("training_date"), "models_trained",
        F.struct(F.col("name"), F.col("r2").alias("r2_score"), F.col("mse")).alias("best_model"),
        F.create_map().cast(T.MapType(T.StringType(), T.DoubleType())).alias("performance_metrics"))
    if importance is not None:
        imp = importance.agg(F.map_from_entries(F.collect_list(F.struct("feature", "importance")))
                             .alias("feature_importance"))  # one entry per feature
        rep = rep.crossJoin(imp)
    else:
        rep = rep.withColumn("feature_importance", F.lit(None).cast(T.MapType(T.StringType(), T.DoubleType())))
    return rep


__all__ = ["train_pump_classifier", "score", "train_regressor_ensemble", "feature_importance",
           "train_health_classifier", "save_model", "load_model", "training_log_row", "model_status",
           "training_report"]
