"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_PRODUCT_COLUMNS = [
    "product_id", "product_name", "category", "discounted_price", "actual_price",
    "discount_percentage", "rating", "rating_count", "about_product", "user_id",
    "user_name", "review_id", "review_title", "review_content", "img_link", "product_link",
]

#: Every raw product column arrives as text; nothing is inferred or rejected at the scan.
RAW_PRODUCT = T.StructType([T.StructField(c, T.StringType()) for c in RAW_PRODUCT_COLUMNS])

MESSAGE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

SESSION = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_activity", T.TimestampNTZType()),
    T.StructField("message_count", T.LongType()),
])

METRIC_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("endpoint", T.StringType()),
    T.StructField("prediction", T.DoubleType()),
    T.StructField("latency", T.DoubleType()),
    T.StructField("query", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("message", T.StringType()),
])

CATEGORICAL_FEATURES = ["main_category", "sub_category", "brand", "price_bucket", "rating_bucket"]

NUMERIC_FEATURES = [
    "actual_price_clean", "rating_clean", "rating_count_log",
    "about_product_length", "review_content_length", "price_log",
    "category_popularity", "brand_popularity", "high_engagement",
    "price_rating_interaction", "engagement_score",
]

FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES

TARGET = "discount_percentage"
