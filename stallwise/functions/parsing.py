"""Readings of the raw product text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Number shape, stripped characters and brand spellings.
FINITE_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ANY_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
MISSING_LEVEL = "Unknown"
MISSING_BRAND = "Unknown"
BRAND_SPELLINGS = {
    "mi": "MI",
    "hp": "HP",
    "lg": "LG",
    "jbl": "JBL",
    "ptron": "pTron",
    "boat": "boAt",
    "iqoo": "iQOO",
}
TWO_WORD_BRANDS = {("amazon", "basics"): "AmazonBasics", ("fire", "boltt"): "Fire-Boltt"}


def strip(text: Column) -> Column:
    """Drop white space, Unicode kinds included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def number(text: Column, shape: str = ANY_NUMBER) -> Column:
    """Text to double; NULL unless the whole text has the shape of a number.

    The guard keeps Java-only forms such as ``1d`` out, ``try_cast`` keeps ANSI
    mode from raising.
    """
    return F.when(text.rlike(shape), text.try_cast("double"))


def clean_price(price: Column) -> Column:
    bare = F.regexp_replace(price.cast("string"), r"(?U)[₹$,\s]", "")
    return F.coalesce(number(bare), F.lit(0.0))


def clean_percentage(percentage: Column) -> Column:
    bare = F.regexp_replace(percentage.cast("string"), r"(?U)[%\s]", "")
    return F.coalesce(number(bare), F.lit(0.0))


def clean_rating(rating: Column) -> Column:
    return F.coalesce(number(strip(rating.cast("string"))), F.lit(0.0))


def clean_rating_count(count: Column) -> Column:
    """Whole number cut toward zero."""
    bare = F.regexp_replace(count.cast("string"), r"(?U)[,\s]", "")
    return F.coalesce(number(bare, FINITE_NUMBER).try_cast("bigint"), F.lit(0).cast("bigint"))


def category_level(category: Column, level: int) -> Column:
    """Trimmed part ``level`` of ``a|b|c``; an absent part is named, an empty one stays empty."""
    parts = F.split(category.cast("string"), r"\|", -1)
    return F.coalesce(strip(F.get(parts, F.lit(level))), F.lit(MISSING_LEVEL))


def extract_brand(name: Column) -> Column:
    words = F.split(strip(name.cast("string")), r"(?U)\s+")
    first = F.regexp_replace(F.get(words, F.lit(0)), "[®™©]", "")
    second = F.lower(F.get(words, F.lit(1)))
    spelled = F.lit(None).cast("string")
    for (left, right), brand in TWO_WORD_BRANDS.items():
        spelled = F.when((F.lower(first) == left) & (second == right), brand).otherwise(spelled)
    table = F.create_map(*[F.lit(x) for pair in BRAND_SPELLINGS.items() for x in pair])
    brand = F.coalesce(spelled, F.try_element_at(table, F.lower(first)), first)
    return F.when(F.length(brand) > 0, brand).otherwise(F.lit(MISSING_BRAND))


def text_length(text: Column) -> Column:
    """Length in code points, 0 for a missing text."""
    return F.length(F.coalesce(text.cast("string"), F.lit("")))


def first_number(text: Column) -> Column:
    """First run of digits and dots after commas are gone; 0 when there is none."""
    found = F.regexp_extract(F.regexp_replace(text, ",", ""), r"[\d.]+", 0)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))
