import pytest
from pyspark.sql import functions as F

from stallwise.functions import parsing as P, scoring as S, text as X

CASES = [
    (P.clean_price, [("₹1,999", 1999.0), ("₹500", 500.0), ("$ 12.5", 12.5), (None, 0.0), ("|", 0.0),
                     ("1d", 0.0), ("", 0.0), ("₹1 099", 1099.0), ("1e3", 1000.0), ("-5", -5.0),
                     ("inf", float("inf")), ("0x10", 0.0)]),
    (P.clean_percentage, [("50%", 50.0), ("25%", 25.0), (" 64 % ", 64.0), (None, 0.0), ("%", 0.0), ("-3%", -3.0)]),
    (P.clean_rating, [("4.2", 4.2), (" 4.2 ", 4.2), (None, 0.0), ("N/A", 0.0), ("|", 0.0), ("4,2", 0.0)]),
    (P.clean_rating_count, [("24,269", 24269), (None, 0), ("12.9", 12), ("-12.9", -12), ("inf", 0), ("many", 0)]),
    (P.extract_brand, [("boAt Rockerz", "boAt"), ("Samsung Galaxy", "Samsung"), (None, "Unknown"), ("  ", "Unknown"),
                       ("Amazon Basics Cable", "AmazonBasics"), ("amazon", "amazon"), ("FIRE  boltt x", "Fire-Boltt"),
                       ("Mi™ 10", "MI"), ("JBL® Go", "JBL"), ("PTRON", "pTron"), ("™", "Unknown"), ("iQoo 9", "iQOO"),
                       ("\tHP ink", "HP")]),
    (P.first_number, [("₹1,299", 1299.0), ("64% off", 64.0), ("4.2/5 (10 reviews)", 4.2), ("none", 0.0), ("a.b", 0.0)]),
    (P.text_length, [("₹boAt", 5), (None, 0), ("", 0), ("👍", 1)]),
]


@pytest.mark.parametrize("function,pairs", CASES, ids=[c[0].__name__ for c in CASES])
def test_values(spark, function, pairs):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], "i int, v string")
    got = [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [want for _, want in pairs]


def test_category_levels(spark):
    values = ["Electronics|Headphones|Wireless", " A | B ", "A|", "", None, "A|B|C|D"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = rows.select("i", *[P.category_level(F.col("v"), n).alias(f"l{n}") for n in range(3)]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("Electronics", "Headphones", "Wireless"), ("A", "B", "Unknown"), ("A", "", "Unknown"),
        ("", "Unknown", "Unknown"), ("Unknown", "Unknown", "Unknown"), ("A", "B", "C")]


def test_buckets(spark):
    prices = [-1.0, 0.0, 0.5, 500.0, 500.5, 2000.0, 10000.0, 50000.0, 50000.5, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(prices)], "i int, v double").orderBy("i")
    got = rows.select(S.price_bucket(F.col("v")).alias("r"), S.price_bucket(F.col("v"), "left").alias("l")).collect()
    assert [r["r"] for r in got] == ["nan", "nan", "very_low", "very_low", "low", "low", "medium", "high", "premium", "nan"]
    assert [r["l"] for r in got][:9] == ["very_low"] * 3 + ["low", "low", "medium", "high", "premium", "premium"]
    ratings = [0.0, 2.5, 3.5, 4.0, 4.5, 5.0, 5.1]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ratings)], "i int, v double").orderBy("i")
    got = rows.select(S.rating_bucket(F.col("v")).alias("r"), S.rating_bucket(F.col("v"), "left").alias("l")).collect()
    assert [r["r"] for r in got] == ["nan", "poor", "average", "good", "very_good", "excellent", "nan"]
    assert [r["l"] for r in got] == ["poor", "average", "good", "very_good", "excellent", "excellent", "excellent"]


def test_explanation_cuts(spark):
    rows = spark.createDataFrame([(14.99,), (15.0,), (35.0,), (55.0,)], "p double")
    got = [r["s"]["category"] for r in rows.select(S.explain_discount(F.col("p")).alias("s")).collect()]
    assert got == ["minimal_discount", "moderate_discount", "significant_discount", "deep_discount"]


def test_interval_and_texts(spark):
    low, high = S.interval(F.lit(5.0), F.lit(10.0))
    row = spark.range(1).select(
        low.alias("low"), high.alias("high"), X.percent_text(F.lit(62.5)).alias("even"),
        S.fixed_decimals(F.lit(1016.675), 1).alias("fixed"), S.suggested_price(F.lit(200.0), F.lit(25.0)).alias("s"),
        S.interval_rmse(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("rmse")).first()
    assert (row["low"], round(row["high"], 6)) == (0.0, 24.6)
    assert (row["even"], row["fixed"], row["s"], row["rmse"]) == ("62%", "1016.7", 150.0, 10.0)


def test_intent_order(spark):
    asked = ["What does it COST?", "best deal", "any offer", "popular ones", "hello", "stopwatch"]
    rows = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").orderBy("i")
    got = [r["x"] for r in rows.select(X.intent(F.col("q")).alias("x")).collect()]
    assert got == ["price", "recommend", "discount", "rating", "general", "recommend"]


def test_records(spark):
    text = "Product: A\nSale Price: 1\n\nno field here\n \nRating : 4 : x\nRating: 5\n:empty"
    rows = spark.createDataFrame([(text,)], "t string").select(X.records(F.col("t")).alias("r"))
    found = [[(f["key"], f["value"]) for f in record] for record in rows.first()["r"]]
    assert found == [[("product", "A"), ("sale_price", "1")], [("rating", "4 : x"), ("rating", "5"), ("", "empty")]]
    assert rows.select(X.last_value(F.col("r")[1], "rating").alias("v")).first()["v"] == "5"
