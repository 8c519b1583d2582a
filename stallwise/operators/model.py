"""The discount regressor: fit, score, measure, explain."""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.regression import (
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.functions import scoring as S
from stallwise.schemas import TARGET
from stallwise.session import materialise, shared_folder

# Model defaults and drift limits.
BOOSTING = {"n_estimators": 200, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8,
            "colsample_bytree": 0.8, "random_state": 42}
FOREST = {"n_estimators": 200, "max_depth": 10, "min_samples_split": 5, "random_state": 42}
DRIFT_SAMPLES = 100
DRIFT_LIMIT = 0.5
HISTORY = 1000
FOLDS = 5
TOP_FACTORS = 5
#: Rows of a partition that a tree is fitted on, as long as cores are idle.
FIT_ROWS = 25_000

MODEL_TYPES = ("xgboost", "gradient_boosting", "random_forest")


def create_regressor(model_type: str = "xgboost", params: dict | None = None):
    """``xgboost`` samples rows and columns, ``gradient_boosting`` neither."""
    params = params or {}
    common = {"featuresCol": "features", "labelCol": TARGET, "predictionCol": "raw_prediction",
              "checkpointInterval": 25}
    if model_type == "random_forest":
        p = {**FOREST, **params}
        return RandomForestRegressor(
            numTrees=p["n_estimators"], maxDepth=p["max_depth"], featureSubsetStrategy="all",
            minInstancesPerNode=max(1, p["min_samples_split"] // 2), seed=p["random_state"],
            cacheNodeIds=True, **common)
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}")
    p = {**BOOSTING, **params}
    boosted = GBTRegressor(
        maxIter=p["n_estimators"], maxDepth=p["max_depth"], stepSize=p["learning_rate"],
        seed=p["random_state"], **common)
    if model_type == "xgboost":
        boosted.setSubsamplingRate(p["subsample"])
        boosted.setFeatureSubsetStrategy(str(p["colsample_bytree"]))
    return boosted


def packed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, stored in partitions of the session's advisory size: fitting a tree is one pass a level, and a small
    table in many partitions would spend it on starting tasks. A table that is small in bytes but not in rows goes to
    as many partitions as there are cores, since a pass takes time by rows."""
    stored = materialise(rows.hint("rebalance"), name)
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(stored.count() / FIT_ROWS))
    if len(stored.inputFiles()) < parts:
        stored = materialise(stored.repartition(parts), name)
    return stored


def hash_split(df: DataFrame, key: str, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """(4/5, 1/5) by key: the same rows on every run, whatever the partitioning."""
    part = fold_of(F.col(key), parts)
    return df.filter(part != 0), df.filter(part == 0)


def fold_of(key: Column, folds: int = FOLDS, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def regression_metrics(
    scored: DataFrame, label: str = TARGET, prediction: str = "prediction", prefix: str = "val"
) -> DataFrame:
    """One row: RMSE, MAE and R² with a prefix."""
    error = F.col(label) - F.col(prediction)
    spread = F.var_pop(label) * F.count(label)
    residual = F.sum(error * error)
    return scored.agg(
        F.sqrt(F.avg(error * error)).alias(f"{prefix}_rmse"),
        F.avg(F.abs(error)).alias(f"{prefix}_mae"),
        F.when(spread > 0, 1 - residual / spread)
        .otherwise(F.when(residual == 0, 1.0).otherwise(0.0)).alias(f"{prefix}_r2"),
    )


def clipped(scored: DataFrame, raw: str = "raw_prediction") -> DataFrame:
    return scored.withColumn("prediction", S.clip(F.col(raw)))


def prediction_drift(recent: DataFrame, reference: DataFrame, column: str = "prediction") -> DataFrame:
    """Compare the recent predictions with the reference; one row.

    ``recent`` holds at most the last hundred predictions.
    """
    ref = reference.agg(F.struct(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.count(column).alias("n")
    ).alias("r")).scalar()
    now = recent.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
                     F.count(column).alias("n"), F.first(F.lit(1)).alias("_")).withColumn("ref", ref)
    enough = (F.col("ref.n") > 0) & (F.col("n") >= DRIFT_SAMPLES)
    mean_drift = F.abs(F.col("mean") - F.col("ref.mean")) / (F.col("ref.std") + 1e-10)
    std_drift = F.abs(F.col("std") - F.col("ref.std")) / (F.col("ref.std") + 1e-10)
    return now.select(
        F.coalesce(enough & ((mean_drift > DRIFT_LIMIT) | (std_drift > DRIFT_LIMIT)), F.lit(False))
        .alias("drift_detected"),
        F.when(~enough, "Insufficient data").alias("reason"),
        F.when(enough, mean_drift).alias("mean_drift"),
        F.when(enough, std_drift).alias("std_drift"),
        F.when(enough, F.col("ref.mean")).alias("reference_mean"),
        F.when(enough, F.col("mean")).alias("current_mean"),
        F.when(enough, F.col("n")).alias("samples_analyzed"),
    )


def importance_table(importances, names: list[str] | None, spark: SparkSession) -> DataFrame:
    """(feature, importance, rank): as many rows as the model has inputs."""
    values = [float(v) for v in importances.toArray()]
    if not names or len(names) != len(values):
        names = [f"feature_{i}" for i in range(len(values))]
    ranked = sorted(enumerate(zip(names, values)), key=lambda item: (-item[1][1], item[0]))
    rows = [(name, value, rank) for rank, (_, (name, value)) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


@dataclass
class DiscountModel:
    """A fitted regressor with its figures.

    ``metrics`` is a handful of numbers, ``importances`` one row per input;
    ``reference_predictions`` and ``history`` are tables.
    """

    model_type: str = "xgboost"
    params: dict = field(default_factory=dict)
    model: object = None
    metrics: dict = field(default_factory=dict)
    importances: DataFrame | None = None
    reference_predictions: DataFrame | None = None
    history: DataFrame | None = None

    def train(self, train: DataFrame, val: DataFrame | None = None,
              feature_names: list[str] | None = None, now: str | None = None) -> dict:
        """Fit on ``train``; both tables carry ``features`` and the target."""
        spark = train.sparkSession
        shared_folder(spark)  # tree fitting cuts its lineage there
        fit_on = packed(train.select("features", TARGET), "fit")
        started = time.time()
        self.model = create_regressor(self.model_type, self.params).fit(fit_on)
        seconds = time.time() - started
        figures = regression_metrics(clipped(self.model.transform(fit_on)), prefix="train").first().asDict()
        if val is not None:
            # Scored once: the same table is measured and kept as drift reference.
            scored = materialise(clipped(self.model.transform(val)).select("prediction", TARGET), "val")
            figures |= regression_metrics(scored, prefix="val").first().asDict()
            self.reference_predictions = scored.select("prediction")
        if feature_names:
            self.importances = importance_table(self.model.featureImportances, feature_names, spark)
        self.metrics = {**figures, "training_time": seconds}
        run = self.run_row(spark, now)
        self.history = run if self.history is None else self.history.unionByName(run)
        return self.metrics

    def run_row(self, spark: SparkSession, now: str | None, trigger: str | None = None) -> DataFrame:
        """One training run: parameters, figures, importances, time and trigger."""
        top = []
        if self.importances is not None:
            top = [(r["feature"], r["importance"]) for r in self.importances.orderBy("rank").collect()]
        row = (now, self.model_type, {k: str(v) for k, v in self.params.items()},
               {k: float(v) for k, v in self.metrics.items() if v is not None}, top, trigger)
        schema = ("timestamp string, model_type string, params map<string,string>, "
                  "metrics map<string,double>, "
                  "importances array<struct<feature:string,importance:double>>, trigger string")
        return spark.createDataFrame([row], schema)

    def predict(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction`` within 0..100."""
        if self.model is None:
            raise ValueError("Model not trained")
        return clipped(self.model.transform(rows)).drop("raw_prediction")

    def rmse(self) -> float:
        return self.metrics.get("val_rmse", self.metrics.get("train_rmse", S.DEFAULT_RMSE))

    def predict_with_interval(self, rows: DataFrame) -> DataFrame:
        low, high = S.interval(F.col("prediction"), F.lit(self.rmse()))
        return self.predict(rows).withColumns({"confidence_lower": low, "confidence_upper": high})

    def top_factors(self, n: int = TOP_FACTORS) -> DataFrame:
        return self.importances.orderBy("rank").limit(n)

    def explain(self, rows: DataFrame) -> DataFrame:
        """Result rows: value, interval, class, texts and the leading factors."""
        factors = F.array().cast("array<struct<name:string,importance:double>>")
        if self.importances is not None:
            factors = F.array(*[
                F.struct(F.lit(r["feature"]).alias("name"), F.lit(r["importance"]).alias("importance"))
                for r in self.top_factors().collect()
            ])
        said = S.explain_discount(F.col("prediction"))
        return self.predict_with_interval(rows).withColumns({
            "predicted_discount": F.round("prediction", 2),
            "confidence_lower": F.round("confidence_lower", 2),
            "confidence_upper": F.round("confidence_upper", 2),
            "category": said["category"],
            "explanation": said["explanation"],
            "recommendation": said["recommendation"],
            "top_factors": factors,
        })

    def check_drift(self, predictions: DataFrame, order: list[str]) -> DataFrame:
        """``predictions`` is the log of all predictions so far."""
        recent = predictions.orderBy(*[F.desc(c) for c in order]).limit(DRIFT_SAMPLES)
        reference = self.reference_predictions
        if reference is None:  # trained without validation rows: nothing to compare with
            reference = recent.select("prediction").limit(0)
        return prediction_drift(recent, reference)

    def cross_validate(self, data: DataFrame, key: str, folds: int = FOLDS, held_out: DiscountModel | None = None
                       ) -> DataFrame:
        """One row: mean and population deviation of the fold RMSEs, and their list.

        Predictions are not clipped here. One fit per fold, each a distributed job;
        the fits are submitted together so that they share the cluster. ``held_out`` is a model of the same type and
        parameters that was fitted on the first part of ``hash_split`` of the same table and key: these are the rows of
        all folds but 0, so it is measured on fold 0 and that fold is not fitted again.
        """
        if held_out is not None and (held_out.model_type, held_out.params, folds) != (self.model_type, self.params, FOLDS):
            raise ValueError("the model given for fold 0 has another type, other parameters or another split")
        spark = data.sparkSession
        shared_folder(spark)
        stored = packed(data.select("features", TARGET, fold_of(F.col(key), folds).alias("fold")), "folds")

        def score(fold: int) -> tuple[int, float]:
            fitted = held_out.model if held_out is not None and fold == 0 else create_regressor(
                self.model_type, self.params).fit(stored.filter(F.col("fold") != fold))
            scored = fitted.transform(stored.filter(F.col("fold") == fold))
            return fold, regression_metrics(scored, prediction="raw_prediction", prefix="cv").first()["cv_rmse"]

        with ThreadPoolExecutor(folds) as pool:
            scores = list(pool.map(score, range(folds)))
        table = spark.createDataFrame(scores, "fold int, rmse double")
        return table.agg(
            F.avg("rmse").alias("cv_rmse_mean"), F.stddev_pop("rmse").alias("cv_rmse_std"),
            F.array_sort(F.collect_list(F.struct("fold", "rmse"))).getField("rmse").alias("cv_scores"),
        )

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        parts = [n for n in ("importances", "reference_predictions", "history") if getattr(self, n) is not None]
        head = [(self.model_type, json.dumps(self.params), {k: float(v) for k, v in self.metrics.items()}, parts)]
        schema = "model_type string, params string, metrics map<string,double>, parts array<string>"
        spark.createDataFrame(head, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        for name in parts:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "DiscountModel":
        head = spark.read.parquet(f"{path}/head").first()
        reader = RandomForestRegressionModel if head["model_type"] == "random_forest" else GBTRegressionModel
        params = json.loads(head["params"])
        out = cls(head["model_type"], params, reader.load(f"{path}/model"), dict(head["metrics"]))
        for name in head["parts"]:
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        return out


def recent_predictions(predictions: DataFrame, order: list[str], n: int = HISTORY) -> DataFrame:
    """The last ``n`` predictions, kept per map partition first (a top-n sort)."""
    return predictions.orderBy(*[F.desc(c) for c in order]).limit(n)
