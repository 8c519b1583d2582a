"""Tables of incoming requests: checks, defaults and serving features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import parsing as P, scoring as S
from stallwise.operators.joins import lookup_join

# Defaults and ranges of the two request kinds.
DEFAULT_CATEGORY = "Electronics"
DEFAULT_SUB_CATEGORY = "Accessories&Peripherals"
DEFAULT_BRAND = "boAt"
DEFAULT_RATING = 4.0
DEFAULT_RATING_COUNT = 100
DEFAULT_SESSION = "default"
DEFAULT_TOP_K = 5
SERVING_CATEGORY_POPULARITY = 100
SERVING_BRAND_POPULARITY = 50
SERVING_ENGAGEMENT_CUT = 1000
MIN_QUESTION_CHARS = 3
MAX_TOP_K = 20
MAX_PAGE = 100


def _with_reasons(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add ``reasons``: names of the rules that do not hold (NULL counts as broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without reasons, rejected rows with one ``reason`` text)."""
    valid = checked.filter(F.size("reasons") == 0).drop("reasons")
    rejected = checked.filter(F.size("reasons") > 0).withColumn("reason", F.array_join("reasons", "; "))
    return valid, rejected.drop("reasons")


def check_products(requests: DataFrame) -> DataFrame:
    filled = requests.withColumns({
        "rating": F.coalesce("rating", F.lit(DEFAULT_RATING)),
        "rating_count": F.coalesce("rating_count", F.lit(DEFAULT_RATING_COUNT).cast("bigint")),
        "about_product": F.coalesce("about_product", F.lit("")),
        "review_content": F.coalesce("review_content", F.lit("")),
    })
    return _with_reasons(filled, [
        ("product_name is missing", F.col("product_name").isNotNull()),
        ("category is missing", F.col("category").isNotNull()),
        ("actual_price must be 0 or more", F.col("actual_price") >= 0),
        ("rating must be 0 to 5", F.col("rating").between(0, 5)),
        ("rating_count must be 0 or more", F.col("rating_count") >= 0),
    ])


def check_questions(questions: DataFrame) -> DataFrame:
    filled = questions.withColumns({
        "session_id": F.coalesce("session_id", F.lit(DEFAULT_SESSION)),
        "top_k": F.coalesce("top_k", F.lit(DEFAULT_TOP_K)),
        "include_sources": F.coalesce("include_sources", F.lit(True)),
    })
    return _with_reasons(filled, [
        ("question must have 3 characters or more", F.length("question") >= MIN_QUESTION_CHARS),
        ("top_k must be 1 to 20", F.col("top_k").between(1, MAX_TOP_K)),
    ])


def check_pages(requests: DataFrame) -> DataFrame:
    return _with_reasons(requests, [
        ("limit must be 1 to 100", F.col("limit").between(1, MAX_PAGE)),
        ("offset must be 0 or more", F.col("offset") >= 0),
    ])


def known_or_default(
    requests: DataFrame, column: str, known: DataFrame, default: str, spread: str
) -> DataFrame:
    """Replace values that were not seen in training.

    ``known`` has one row per seen ``value``. The fixed default is used where it was
    seen, else the smallest seen value; when nothing was seen the value stays.
    """
    fallback = known.agg(
        F.coalesce(F.max(F.when(F.col("value") == default, F.col("value"))), F.min("value")).alias("value")
    ).scalar()
    marked = lookup_join(
        requests, known.select(F.col("value").alias(column), F.lit(True).alias("_known")), column, spread)
    return marked.withColumn(
        column, F.when(F.col("_known"), F.col(column)).otherwise(F.coalesce(fallback, F.col(column)))
    ).drop("_known")


def seen_values(catalogue: DataFrame, column: str) -> DataFrame:
    return catalogue.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()


def _level_or(category: Column, level: int, default: str) -> Column:
    part = F.get(F.split(category, r"\|", -1), F.lit(level))
    return F.when(F.length(part) > 0, part).otherwise(F.lit(default))


def serving_row(requests: DataFrame) -> DataFrame:
    """Features of a request row with the serving rules: left-closed buckets, constant
    popularity and a fixed engagement cut."""
    first_word = F.get(F.split(P.strip(F.col("product_name")), r"(?U)\s+"), F.lit(0))
    price, rating = F.col("actual_price").cast("double"), F.col("rating").cast("double")
    count_log = F.log1p(F.col("rating_count"))
    return requests.withColumns({
        "main_category": _level_or(F.col("category"), 0, DEFAULT_CATEGORY),
        "sub_category": _level_or(F.col("category"), 1, DEFAULT_SUB_CATEGORY),
        "brand": F.when(F.length(first_word) > 0, first_word).otherwise(F.lit(DEFAULT_BRAND)),
        "price_bucket": S.price_bucket(price, closed="left"),
        "rating_bucket": S.rating_bucket(rating, closed="left"),
        "actual_price_clean": price,
        "rating_clean": rating,
        "rating_count_log": count_log,
        "about_product_length": P.text_length(F.col("about_product")),
        "review_content_length": P.text_length(F.col("review_content")),
        "price_log": F.log1p(price),
        "category_popularity": F.lit(SERVING_CATEGORY_POPULARITY),
        "brand_popularity": F.lit(SERVING_BRAND_POPULARITY),
        "high_engagement": (F.col("rating_count") > SERVING_ENGAGEMENT_CUT).cast("int"),
        "price_rating_interaction": F.log1p(price) * rating,
        "engagement_score": rating * count_log,
    })


def training_row(requests: DataFrame, catalogue: DataFrame, median: Column, spread: str) -> DataFrame:
    """Features of a request row with the training rules, looked up in the catalogue."""
    rows = requests.withColumns({
        "main_category": P.category_level(F.col("category"), 0),
        "sub_category": P.category_level(F.col("category"), 1),
        "brand": P.extract_brand(F.col("product_name")),
        "actual_price_clean": F.col("actual_price").cast("double"),
        "rating_clean": F.col("rating").cast("double"),
        "rating_count_log": F.log1p(F.col("rating_count")),
        "about_product_length": P.text_length(F.col("about_product")),
        "review_content_length": P.text_length(F.col("review_content")),
        "high_engagement": (F.col("rating_count") > median).cast("int"),
    })
    rows = rows.withColumns({
        "price_log": S.price_log(F.col("actual_price_clean")),
        "price_bucket": S.price_bucket(F.col("actual_price_clean")),
        "rating_bucket": S.rating_bucket(F.col("rating_clean")),
        "engagement_score": S.engagement(F.col("rating_clean"), F.col("rating_count")),
    }).withColumn("price_rating_interaction", F.col("price_log") * F.col("rating_clean"))
    for column, into in (("main_category", "category_popularity"), ("brand", "brand_popularity")):
        counts = catalogue.groupBy(column).agg(F.count("*").alias(into))
        rows = lookup_join(rows, counts, column, spread)
    return rows.na.fill(0, ["category_popularity", "brand_popularity"])


def serving_features(
    requests: DataFrame, known: dict[str, DataFrame], spread: str, mode: str = "reference",
    catalogue: DataFrame | None = None, median: float | None = None,
) -> DataFrame:
    """Model inputs for request rows.

    ``known`` gives the seen values of main category, sub category and brand.
    ``reference`` follows the serving rules, whose buckets, popularity and engagement
    cut differ from training; ``consistent`` uses the training rules and so needs the
    catalogue and its median rating count.
    """
    if mode == "reference":
        rows = serving_row(requests)
    elif mode == "consistent":
        rows = training_row(requests, catalogue, F.lit(median), spread)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    for column, default in (
        ("main_category", DEFAULT_CATEGORY), ("sub_category", DEFAULT_SUB_CATEGORY), ("brand", DEFAULT_BRAND),
    ):
        rows = known_or_default(rows, column, known[column], default, spread)
    return rows
