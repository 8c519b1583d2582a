"""Questions about the cleaned catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stallwise.operators.clean import catalogue_stats

PAGE_COLUMNS = [
    "product_id", "product_name", "main_category", "discounted_price",
    "actual_price", "rating_clean", "discount_percentage", "brand",
]


def category_distribution(cleaned: DataFrame) -> DataFrame:
    counts = cleaned.groupBy("main_category").agg(F.count("*").alias("products"))
    return counts.orderBy(F.desc("products"), "main_category")


def distinct_counts(cleaned: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return cleaned.agg(
        F.count("*").alias("products"),
        distinct("main_category").alias("categories"),
        distinct("brand").alias("brands"),
    )


def value_ranges(cleaned: DataFrame) -> DataFrame:
    price, discount = "actual_price_clean", "discount_percentage"
    return cleaned.agg(
        F.min(price).alias("price_min"), F.max(price).alias("price_max"), F.avg(price).alias("price_mean"),
        F.min(discount).alias("discount_min"), F.max(discount).alias("discount_max"),
        F.avg(discount).alias("discount_mean"),
    )


def in_category(cleaned: DataFrame, pattern: str | None) -> DataFrame:
    """Keep products whose main category matches the pattern, in any case."""
    if not pattern:
        return cleaned
    return cleaned.filter(F.coalesce(F.col("main_category").rlike(f"(?i){pattern}"), F.lit(False)))


def product_page(
    cleaned: DataFrame, limit: int = 10, offset: int = 0, category: str | None = None, order: str = "ord"
) -> tuple[DataFrame, DataFrame]:
    """(one row ``total``, the page of products in file order)."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1..100 and offset 0 or more")
    kept = in_category(cleaned, category)
    page = kept.orderBy(order).offset(offset).limit(limit).select(order, *PAGE_COLUMNS)
    return kept.agg(F.count("*").alias("total")), page


__all__ = [
    "catalogue_stats", "category_distribution", "distinct_counts", "in_category",
    "product_page", "value_ranges",
]
