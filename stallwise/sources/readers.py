"""Product files and in-memory product tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.schemas import RAW_PRODUCT_COLUMNS

# Texts a CSV reader of the original data takes as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product CSV with header and quoted multi-line text, all columns text.

    Adds ``ord``, the place of the row: (file, row inside the scan). A quoted line
    break keeps one file in one task, so hand in a folder of many files.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", True)
        .option("quote", '"').option("escape", '"').option("enforceSchema", False)
    )
    # The header gives the order of the columns; every file's header is checked against it.
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = reader.schema(schema).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    known = [F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)).alias(c) for c in RAW_PRODUCT_COLUMNS]
    return rows.select(*known, place.alias("ord"))


def as_raw_products(products: DataFrame, order: str | None = None) -> DataFrame:
    """Take an in-memory table in place of a file: text columns, absent ones NULL.

    ``order`` names the column that says which row came first.
    """
    columns = [
        F.col(c).cast("string").alias(c) if c in products.columns else F.lit(None).cast("string").alias(c)
        for c in RAW_PRODUCT_COLUMNS
    ]
    place = F.col(order) if order else F.monotonically_increasing_id()
    return products.select(*columns, place.alias("ord"))


def load_products(spark: SparkSession, source: str | DataFrame, order: str | None = None) -> DataFrame:
    """A path or a table."""
    return as_raw_products(source, order) if isinstance(source, DataFrame) else read_products(spark, source)
