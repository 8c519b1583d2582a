"""Document text, previews and record parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallwise.functions.parsing import strip

# Lengths, labels and keyword groups.
DESCRIPTION_CHARS = 500
REVIEW_CHARS = 300
CONTEXT_CHARS = 200
QUERY_CHARS = 100
CONTEXT_HEADER = "Previous conversation:"
MISSING_TEXT = "N/A"
MISSING_FIELD = "nan"
INTENT_KEYWORDS = [
    ("price", ["price", "cost", "cheap", "expensive", "budget"]),
    ("recommend", ["best", "recommend", "suggest", "top"]),
    ("discount", ["discount", "offer", "deal", "sale"]),
    ("rating", ["rating", "review", "popular"]),
]
GENERAL_INTENT = "general"
CHEAPEST_KEYWORDS = ["cheap", "under", "budget"]


def percent_text(discount: Column) -> Column:
    """Whole percent, halves to even."""
    return F.concat(F.bround(discount, 0).cast("bigint").cast("string"), F.lit("%"))


def document_text() -> Column:
    """Ten-line description of a cleaned product row."""
    def field(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(MISSING_FIELD))

    def excerpt(name: str, chars: int) -> Column:
        return F.coalesce(F.substring(F.col(name).cast("string"), 1, chars), F.lit(MISSING_TEXT))

    lines = [
        ("Product", field("product_name")),
        ("Product ID", field("product_id")),
        ("Brand", field("brand")),
        ("Category", F.concat(field("main_category"), F.lit(" > "), field("sub_category"))),
        ("Original Price", field("actual_price")),
        ("Sale Price", field("discounted_price")),
        ("Discount", F.concat(percent_text(F.col("discount_percentage")), F.lit(" off"))),
        ("Rating", F.concat(
            F.col("rating_clean").cast("string"), F.lit("/5 ("),
            F.format_number(F.col("rating_count_clean"), 0), F.lit(" reviews)"))),
        ("Description", excerpt("about_product", DESCRIPTION_CHARS)),
        ("Review", excerpt("review_content", REVIEW_CHARS)),
    ]
    return strip(F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines]))


def context_line(role: Column, content: Column) -> Column:
    speaker = F.when(role == "user", "User").otherwise("Assistant")
    said = F.when(
        F.length(content) > CONTEXT_CHARS,
        F.concat(F.substring(content, 1, CONTEXT_CHARS), F.lit("...")),
    ).otherwise(content)
    return F.concat(speaker, F.lit(": "), said)


def query_excerpt(query: Column) -> Column:
    return F.substring(query, 1, QUERY_CHARS)


def seconds_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def contains_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def intent(question: Column) -> Column:
    found = F.lit(GENERAL_INTENT)
    for name, words in reversed(INTENT_KEYWORDS):
        found = F.when(contains_any(question, words), name).otherwise(found)
    return found


def records(text: Column) -> Column:
    """Cut a text at its blank lines and keep the pieces that hold a ``key: value`` line.

    Gives an array (one item per record) of arrays of ``{key, value}``.
    """
    blocks = F.split(text, r"(?U)\n\s*\n", -1)

    def fields(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n", -1), lambda line: F.contains(line, F.lit(":")))
        return F.transform(lines, _key_value)

    return F.filter(F.transform(blocks, fields), lambda found: F.size(found) > 0)


def _key_value(line: Column) -> Column:
    at = F.instr(line, ":")
    key = F.replace(F.lower(strip(F.left(line, at - 1))), F.lit(" "), F.lit("_"))
    return F.struct(key.alias("key"), strip(F.substr(line, at + 1)).alias("value"))


def last_value(fields: Column, key: str) -> Column:
    """Value of the last field named ``key`` in one record, NULL when it has none."""
    return F.try_element_at(F.filter(fields, lambda f: f["key"] == key), F.lit(-1))["value"]
