"""Derived features, label codes and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.functions import scoring as S
from stallwise.operators.joins import lookup_join
from stallwise.operators.ordered import label_index
from stallwise.operators.quantiles import exact_median
from stallwise.schemas import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES, TARGET
from stallwise.session import materialise, scratch_path


def row_features(cleaned: DataFrame) -> DataFrame:
    """Features that need nothing but their own row."""
    return cleaned.withColumns({
        "price_log": S.price_log(F.col("actual_price_clean")),
        "price_bucket": S.price_bucket(F.col("actual_price_clean")),
        "rating_bucket": S.rating_bucket(F.col("rating_clean")),
        "rating_count_log": F.log1p("rating_count_clean"),
        "engagement_score": S.engagement(F.col("rating_clean"), F.col("rating_count_clean")),
    }).withColumn("price_rating_interaction", F.col("price_log") * F.col("rating_clean"))


def frequencies(cleaned: DataFrame, column: str, into: str) -> DataFrame:
    return cleaned.groupBy(column).agg(F.count("*").alias(into))


def with_popularity(df: DataFrame, cleaned: DataFrame, spread: str = "product_id") -> DataFrame:
    """Attach how many products share the category and the brand."""
    for column, into in (("main_category", "category_popularity"), ("brand", "brand_popularity")):
        df = lookup_join(df, frequencies(cleaned, column, into), column, spread)
    return df


def with_engagement_flag(df: DataFrame, cleaned: DataFrame) -> DataFrame:
    median = exact_median(cleaned, "rating_count_clean")
    return df.withColumn("high_engagement", (F.col("rating_count_clean") > F.lit(median)).cast("int"))


def engineer_features(cleaned: DataFrame, spread: str = "product_id") -> DataFrame:
    """All nine derived columns. ``cleaned`` is read several times: hand in a stored table."""
    return with_engagement_flag(with_popularity(row_features(cleaned), cleaned, spread), cleaned)


def mode_value(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, the smallest one on a tie."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("value"))


def label_table(features: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, label, code): distinct labels numbered from 0 in code point order."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("label")) for c in columns
    ])).alias("p")
    labels = features.select(pairs).select("p.*").where("label IS NOT NULL")
    return label_index(labels, "feature", "label", "code", "labels")


def numeric_or_zero(column: str) -> Column:
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))


def scaling_stats(coded: DataFrame) -> DataFrame:
    """One row with mean and population deviation of every model input."""
    return coded.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in FEATURES],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in FEATURES],
    )


def feature_table(cleaned: DataFrame, spread: str = "product_id") -> DataFrame:
    """The derived columns with the key and the target, without the product texts."""
    engineered = engineer_features(cleaned, spread)
    return engineered.select(*dict.fromkeys([spread, "ord", "rating_count_clean", TARGET, *FEATURES]))


@dataclass
class FittedFeatures:
    """Label tables, fill values and scaling learned from the training features.

    ``labels_path`` is a Parquet table partitioned by feature, so the planner sees
    the true size of each label table. The next two are one value per column.
    ``catalogue`` is the one row of figures of the cleaned table, if they were asked for.
    """

    spark: SparkSession
    labels_path: str
    fills: dict[str, str]
    scaling: dict[str, tuple[float, float]]
    catalogue: DataFrame | None = None

    @classmethod
    def fit(cls, features: DataFrame, spread: str = "product_id") -> "FittedFeatures":
        """Learn from ``features`` (read several times: hand in a stored table)."""
        return cls.fit_transform(features, spread)[0]

    @classmethod
    def fit_transform(
        cls, features: DataFrame, spread: str = "product_id", keep: list[str] | None = None
    ) -> tuple["FittedFeatures", DataFrame]:
        """(fitted, model matrix of the training rows).

        The coded rows are stored once; scaling is learned from them and applied to them.
        """
        spark = features.sparkSession
        gaps = features.agg(*[
            F.count_if(F.col(c).isNull()).alias(c) for c in CATEGORICAL_FEATURES
        ]).first()
        modes = {c: mode_value(features, c).first() for c in CATEGORICAL_FEATURES if gaps[c]}
        fills = {c: mode["value"] for c, mode in modes.items() if mode}  # none in a column that is all null
        filled = features.na.fill(fills) if fills else features
        path = scratch_path(spark, "label-tables")
        label_table(filled, CATEGORICAL_FEATURES).write.partitionBy("feature").parquet(path)
        fitted = cls(spark, path, fills, {})
        keep = keep if keep is not None else fitted._others(features)
        needed = filled.select(*dict.fromkeys([*keep, spread, *FEATURES]))
        coded = materialise(fitted.encode(needed, spread), "coded")
        stats = scaling_stats(coded).first()
        fitted.scaling = {c: (stats[f"{c}_mean"], stats[f"{c}_std"]) for c in FEATURES}
        return fitted, fitted.scale(coded, keep)

    def labels(self, feature: str | None = None) -> DataFrame:
        table = self.spark.read.schema("label string, code bigint, feature string").parquet(self.labels_path)
        return table if feature is None else table.filter(F.col("feature") == feature)

    def encode(self, features: DataFrame, spread: str = "product_id") -> DataFrame:
        """Replace each category by its code; what was not seen in training gets code 0."""
        out = features
        for column in CATEGORICAL_FEATURES:
            codes = self.labels(column).select(F.col("label").alias(column), F.col("code").alias(f"_{column}"))
            out = lookup_join(out, codes, column, spread)
        codes = {c: F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("double") for c in CATEGORICAL_FEATURES}
        numbers = {c: numeric_or_zero(c) for c in NUMERIC_FEATURES}
        return out.withColumns({**codes, **numbers}).drop(*[f"_{c}" for c in CATEGORICAL_FEATURES])

    def scaled(self, column: str) -> Column:
        mean, std = self.scaling[column]
        return (F.col(column) - F.lit(mean)) / F.lit(std if std else 1.0)

    @staticmethod
    def _others(features: DataFrame) -> list[str]:
        return [c for c in features.columns if c not in FEATURES]

    def scale(self, coded: DataFrame, keep: list[str]) -> DataFrame:
        scaled = coded.select(*keep, *[self.scaled(c).alias(c) for c in FEATURES])
        return scaled.withColumn("features", array_to_vector(F.array(*FEATURES)))

    def transform(self, features: DataFrame, spread: str = "product_id", keep: list[str] | None = None) -> DataFrame:
        """Codes and numbers, scaled, plus the 16-wide ``features`` vector in fixed order."""
        keep = keep if keep is not None else self._others(features)
        needed = features.select(*dict.fromkeys([*keep, spread, *FEATURES]))
        return self.scale(self.encode(needed, spread), keep)

    def save(self, path: str) -> None:
        """Label tables, a one-row-per-column statistics table and the catalogue figures below ``path``."""
        self.labels().write.mode("overwrite").partitionBy("feature").parquet(f"{path}/labels")
        known = self.catalogue is not None
        if known:
            self.catalogue.write.mode("overwrite").parquet(f"{path}/catalogue")
        rows = [(c, self.fills.get(c), *self.scaling[c], known) for c in FEATURES]
        schema = "feature string, fill string, mean double, std double, catalogue boolean"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedFeatures":
        rows = spark.read.parquet(f"{path}/stats").collect()  # one row per model input
        fills = {r["feature"]: r["fill"] for r in rows if r["fill"] is not None}
        scaling = {r["feature"]: (r["mean"], r["std"]) for r in rows}
        catalogue = spark.read.parquet(f"{path}/catalogue") if rows[0]["catalogue"] else None
        return cls(spark, f"{path}/labels", fills, scaling, catalogue)
