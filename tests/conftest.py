import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from stallwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample_products(spark):
    """One hundred raw product rows in the shape of the catalogue file."""
    from stallwise.schemas import RAW_PRODUCT_COLUMNS
    from stallwise.sources.readers import as_raw_products

    brands = ["boAt", "Samsung", "Philips", "Mi", "Anker"]
    categories = ["Electronics|Headphones", "Computers|Cables", "Home|Kitchen"]
    rows = []
    for i in range(100):
        price = 500 + (i * 7919) % 9500
        rows.append((
            f"B0{i:08d}", f"{brands[i % 5]} Product {i}", categories[i % 3], f"₹{100 + (i * 613) % 4900:,}",
            f"₹{price:,}", f"{10 + (i * 37) % 60}%", f"{3.0 + (i % 21) / 10:.1f}", f"{100 + (i * 997) % 49900:,}",
            f"Great product {i} with features", f"U{i}", "User", f"R{i}", "Good", "Nice product", "http://img", "http://p"))
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_PRODUCT_COLUMNS))
    return as_raw_products(table, order="product_id")
