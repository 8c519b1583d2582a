"""Raw products to a fitted discount model, a product index and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from stallwise.functions import text as X
from stallwise.operators import catalog, retrieval as R
from stallwise.operators.clean import catalogue_stats, load_and_clean
from stallwise.operators.features import FittedFeatures, feature_table
from stallwise.operators.model import DiscountModel, hash_split
from stallwise.schemas import FEATURES, TARGET
from stallwise.session import materialise


@dataclass
class Prepared:
    """Stored tables that every later step reads."""

    cleaned: DataFrame
    features: DataFrame
    fitted: FittedFeatures
    matrix: DataFrame


def prepare(raw: DataFrame) -> Prepared:
    """Clean, derive, encode and scale.

    The cleaned table and the feature table are each written once: the frequency
    counts, the median, the label tables and the scaling all read them again.
    Scaling is learned from all rows before the split.
    """
    cleaned = materialise(load_and_clean(raw), "cleaned")
    features = materialise(feature_table(cleaned), "features")
    fitted, matrix = FittedFeatures.fit_transform(features, keep=["product_id", TARGET])
    fitted.catalogue = catalogue_stats(cleaned)
    return Prepared(cleaned, features, fitted, matrix)


def train(prepared: Prepared, model_type: str = "xgboost", params: dict | None = None,
          now: str | None = None) -> DiscountModel:
    fit_on, held_out = hash_split(prepared.matrix, "product_id")
    model = DiscountModel(model_type, params or {})
    model.train(fit_on, held_out, FEATURES, now)
    return model


def build_index(cleaned: DataFrame) -> tuple[DataFrame, PipelineModel]:
    """(stored index table, fitted text encoder)."""
    documents = cleaned.withColumn("rag_document", X.document_text())
    rows = materialise(R.index_rows(documents), "index-rows")
    encoder = R.fit_encoder(rows)
    return materialise(R.encode(rows, encoder), "index"), encoder


def training_summary(cleaned: DataFrame, model: DiscountModel, cv: DataFrame | None, rag_stats: DataFrame,
                     now: str | None = None) -> DataFrame:
    """One nested row: data set, model figures, retrieval statistics."""
    ranges = catalog.value_ranges(cleaned).select(
        F.array("price_min", "price_max").alias("price_range"),
        F.array("discount_min", "discount_max").alias("discount_range"))
    dataset = catalog.distinct_counts(cleaned).select(
        F.col("products").alias("total_products"), "categories", "brands").withColumns({
            name: ranges.select(name).scalar() for name in ("price_range", "discount_range")})
    score = cv.select("cv_rmse_mean").scalar() if cv is not None else F.lit(None).cast("double")
    figures = [F.lit(model.metrics.get(n)).cast("double").alias(n)
               for n in ("train_rmse", "val_rmse", "train_r2", "val_r2")]
    return dataset.select(F.struct("*").alias("dataset")).withColumns({
        "model": F.struct(*figures, score.alias("cv_rmse")),
        "rag": rag_stats.select(F.struct(*rag_stats.columns).alias("s")).scalar(),
        "timestamp": F.lit(now).cast("string")})


def model_summary(model: DiscountModel) -> str:
    """Printed figures of a trained model."""
    def line(label: str, name: str) -> str:
        value = model.metrics.get(name)
        return f"  {label} {value:.4f}" if value is not None else f"  {label} N/A"

    rule = "=" * 50
    parts = [rule, "DISCOUNT PREDICTION MODEL SUMMARY", rule, f"Model Type: {model.model_type}", "",
             "Training Metrics:", line("RMSE:", "train_rmse"), line("MAE: ", "train_mae"),
             line("R²:  ", "train_r2"), "", "Validation Metrics:", line("RMSE:", "val_rmse"),
             line("MAE: ", "val_mae"), line("R²:  ", "val_r2"), "",
             f"Training Time: {model.metrics.get('training_time', 0.0):.2f}s", rule]
    return "\n".join(parts)
