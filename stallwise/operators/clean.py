"""Cleaning of the raw product table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import parsing as P
from stallwise.operators.ordered import first_rows


TEXTS = ("about_product", "review_content", "product_name")
#: Texts in tables of their own: column -> (key of a product row, table of ``key`` and ``text``).
KeyedTexts = dict[str, tuple[Column, DataFrame]]


def text_lengths(raw: DataFrame, texts: KeyedTexts | None = None) -> DataFrame:
    """Lengths of the three texts; one of ``texts`` is measured in its own table and joined as a number."""
    texts = texts or {}
    out = raw.withColumns({f"{name}_length": P.text_length(F.col(name)) for name in TEXTS if name not in texts})
    for name, (key, table) in texts.items():
        lengths = table.groupBy(F.col("key").alias("_key")).agg(F.min(P.text_length(F.col("text"))).alias("_length"))
        out = out.withColumn("_key", key).join(lengths, "_key", "left").withColumn(
            f"{name}_length", F.coalesce("_length", P.text_length(F.lit(None).cast("string")))).drop("_key", "_length")
    return out


def with_texts(rows: DataFrame, texts: KeyedTexts, chars: dict[str, int] | None = None) -> DataFrame:
    """Attach ``texts`` to product rows; of texts with one key the shortest, as ``text_lengths`` takes it.

    ``chars`` names the beginnings that a caller reads, so that no more than these are moved.
    """
    out = rows.drop(*texts)
    for name, (key, table) in texts.items():
        text = F.substring("text", 1, chars[name]) if chars else F.col("text")
        one = table.groupBy(F.col("key").alias("_key")).agg(
            F.min(F.struct(P.text_length(F.col("text")).alias("n"), text.alias("text"))).alias("_text"))
        out = out.withColumn("_key", key).join(one, "_key", "left").withColumn(name, F.col("_text.text")).drop(
            "_key", "_text")
    return out


def clean_columns(raw: DataFrame) -> DataFrame:
    """Numbers, category levels and brand out of the raw text columns."""
    return raw.withColumns({
        "actual_price_clean": P.clean_price(F.col("actual_price")),
        "discounted_price_clean": P.clean_price(F.col("discounted_price")),
        "discount_percentage": P.clean_percentage(F.col("discount_percentage")),
        "rating_clean": P.clean_rating(F.col("rating")),
        "rating_count_clean": P.clean_rating_count(F.col("rating_count")),
        "main_category": P.category_level(F.col("category"), 0),
        "sub_category": P.category_level(F.col("category"), 1),
        "sub_sub_category": P.category_level(F.col("category"), 2),
        "brand": P.extract_brand(F.col("product_name")),
    })


def first_per_name(df: DataFrame, order: str = "ord") -> DataFrame:
    """First row of each product name in file order; missing names count as one name."""
    return first_rows(df, ["product_name"], [F.col(order)], 1, "_copy").drop("_copy")


def valid_products(df: DataFrame) -> DataFrame:
    return (
        df.na.drop(subset=["product_id"])
        .filter(F.col("actual_price_clean") > 0)
        .filter((F.col("discount_percentage") >= 0) & (F.col("discount_percentage") <= 100))
    )


def load_and_clean(raw: DataFrame, order: str = "ord", texts: KeyedTexts | None = None) -> DataFrame:
    """Raw product rows to the cleaned product table.

    Names are made unique before the validity filters, as the order changes the
    result. Lengths are taken ahead of that shuffle so that plans which need only
    the lengths do not move the texts. Where ``texts`` lie in tables of their own the
    result has their lengths only; ``with_texts`` attaches them.
    """
    if texts:
        kept = valid_products(clean_columns(first_per_name(raw.drop(*texts), order)))
        return text_lengths(kept, texts)
    return valid_products(clean_columns(first_per_name(text_lengths(raw), order)))


def catalogue_stats(cleaned: DataFrame) -> DataFrame:
    """One row: size, distinct brands and categories, mean and sample deviation."""
    return cleaned.agg(
        F.count("*").alias("total_products"),
        F.countDistinct("brand").alias("unique_brands"),
        F.countDistinct("main_category").alias("unique_categories"),
        F.avg("actual_price_clean").alias("price_mean"),
        F.stddev_samp("actual_price_clean").alias("price_std"),
        F.avg("discount_percentage").alias("discount_mean"),
        F.stddev_samp("discount_percentage").alias("discount_std"),
    )
