"""Buckets, feature arithmetic, intervals and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Bucket edges and names, class cut points and texts.
PRICE_EDGES = [(500, "very_low"), (2000, "low"), (10000, "medium"), (50000, "high"), (None, "premium")]
RATING_EDGES = [(2.5, "poor"), (3.5, "average"), (4.0, "good"), (4.5, "very_good"), (5.0, "excellent")]
OUT_OF_RANGE = "nan"
DISCOUNT_CLASSES = [
    (15, "minimal_discount",
     "Low discount recommended. Product has strong demand or premium positioning.",
     "Consider maintaining current price or minimal promotional discount."),
    (35, "moderate_discount",
     "Standard promotional discount suitable.",
     "Apply 20-35% discount for effective promotion."),
    (55, "significant_discount",
     "Higher discount indicated due to competitive pressure or inventory needs.",
     "Consider bundle offers or seasonal promotions."),
    (None, "deep_discount",
     "Deep discount suggested. Review pricing strategy.",
     "Evaluate clearance options or price repositioning."),
]
INTERVAL_Z = 1.96
DEFAULT_RMSE = 10.0


def _first_match(branches: list[tuple[Column, object]], otherwise: object) -> Column:
    return reduce(
        lambda rest, branch: F.when(branch[0], F.lit(branch[1])).otherwise(rest),
        reversed(branches),
        F.lit(otherwise),
    )


def _training_bucket(value: Column, edges: list) -> Column:
    """Right-closed buckets starting above 0; what falls outside is named, not dropped."""
    known = value.isNotNull() & ~F.isnan(value) & (value > 0)
    branches = [(known & ((value <= top) if top is not None else F.lit(True)), name) for top, name in edges]
    return _first_match(branches, OUT_OF_RANGE)


def _serving_bucket(value: Column, edges: list) -> Column:
    """Left-closed buckets, the last one open."""
    *bounded, (_, last) = edges
    return _first_match([(value < top, name) for top, name in bounded], last)


def price_bucket(price: Column, closed: str = "right") -> Column:
    price = price.cast("double")
    return _training_bucket(price, PRICE_EDGES) if closed == "right" else _serving_bucket(price, PRICE_EDGES)


def rating_bucket(rating: Column, closed: str = "right") -> Column:
    rating = rating.cast("double")
    return _training_bucket(rating, RATING_EDGES) if closed == "right" else _serving_bucket(rating, RATING_EDGES)


def price_log(price: Column) -> Column:
    return F.log1p(price)


def engagement(rating: Column, rating_count: Column) -> Column:
    return rating * F.log1p(rating_count)


def clip(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def interval(prediction: Column, rmse: Column) -> tuple[Column, Column]:
    width = F.lit(INTERVAL_Z) * rmse
    return clip(prediction - width), clip(prediction + width)


def interval_rmse(val_rmse: Column, train_rmse: Column) -> Column:
    return F.coalesce(val_rmse, train_rmse, F.lit(DEFAULT_RMSE))


def explain_discount(prediction: Column) -> Column:
    """Struct of class, explanation and recommendation."""
    def pick(field: int) -> Column:
        *bounded, last = DISCOUNT_CLASSES
        return _first_match([(prediction < row[0], row[field]) for row in bounded], last[field])

    return F.struct(
        pick(1).alias("category"), pick(2).alias("explanation"), pick(3).alias("recommendation")
    )


def suggested_price(price: Column, discount: Column) -> Column:
    return price * (F.lit(1.0) - discount / F.lit(100.0))


def score_label(score: Column) -> Column:
    return _first_match([(score > 0.7, "high"), (score > 0.5, "medium")], "low")


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days from one timestamp to another."""
    return F.floor(F.timestamp_diff("SECOND", earlier, later) / F.lit(86400)).cast("bigint")


def fixed_decimals(value: Column, places: int) -> Column:
    """Text with exactly ``places`` decimals, halves to even, no thousands commas."""
    return F.bround(value, places).cast(f"decimal(28,{places})").cast("string")
