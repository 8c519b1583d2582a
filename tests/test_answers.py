import pytest
from pyspark.sql import functions as F

from stallwise.functions import text as X
from stallwise.operators import answers as A, retrieval as R
from stallwise.operators.clean import load_and_clean
from stallwise.plans import serving as PS, training as PT


def text(name, price, discount, rating, extra=""):
    return (f"Product: {name}\nProduct ID: X\nBrand: B\nSale Price: {price}\nDiscount: {discount} off\n"
            f"Rating: {rating}/5 (10 reviews)\nDescription: d{extra}")


LONG = "Very " * 12 + "long"
TEXTS = [("a", text("Cable", "₹1,299", "64%", 4.2)), ("b", text(LONG, "₹300", "10%", 4.2)),
         ("c", text("Kettle", "₹800", "64%", 4.5))]
CHEAPEST = (f"The most affordable option is **{LONG[:50]}** at ₹300 (10% off off). Rating: 4.2/5 (10 reviews)")


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(1, d, 0.9 - i / 10, i + 1, t) for i, (d, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "query_id long, doc_id string, score double, rank int, text string")


def answer(hits, question):
    products = A.question_products(hits)
    return products.select(A.template_answer(F.col("products"), F.lit(question)).alias("a")).first()["a"]


def test_price_answers(hits):
    assert answer(hits, "What is CHEAP?") == CHEAPEST
    assert answer(hits, "price under 500") == CHEAPEST
    assert answer(hits, "price") == (
        "Here are products sorted by price:\n\n"
        f"1. **{LONG[:40]}** - ₹300\n2. **Kettle** - ₹800\n3. **Cable** - ₹1,299\n")


def test_recommendation(hits):
    assert answer(hits, "recommend one") == (
        "Based on ratings, I recommend **Kettle**.\n\n• Price: ₹800 (64% off)\n• Rating: 4.5/5 (10 reviews)\n• Brand: B\n"
        f"\n**Other options:**\n• Cable - 4.2/5 (10 reviews)\n• {LONG[:40]} - 4.2/5 (10 reviews)\n")
    alone = answer(hits.filter("rank = 1"), "best")
    assert alone.endswith("• Brand: B\n") and "Other" not in alone


def test_lists(hits):
    assert answer(hits, "any discount") == (
        "Best discount deals:\n\n1. **Cable** - 64% off off (Now ₹1,299)\n2. **Kettle** - 64% off off (Now ₹800)\n"
        f"3. **{LONG[:40]}** - 10% off off (Now ₹300)\n")
    assert answer(hits, "most popular").startswith("Top-rated products:\n\n1. **Kettle** - ⭐ 4.5/5 (10 reviews)\n2. **Cable**")
    assert answer(hits, "hello").startswith(
        "I found 3 relevant products (sorted by reviews):\n\n**1. Kettle**\n   • Price: ₹800 (64% off)\n   • Rating: 4.5/5 (10 reviews)\n\n")


def test_a_blank_line_starts_another_record(spark):
    rows = [(1, "a", 0.9, 1, text("Cable", "₹5", "1%", 4.0, "\n\nNote: spare part\nmore"))]
    hits = spark.createDataFrame(rows, "query_id long, doc_id string, score double, rank int, text string")
    products = A.question_products(hits).first()["products"]
    assert [p["product"] for p in products] == ["Cable", None]
    assert answer(hits, "hello").startswith("I found 2 relevant products")


def test_only_five_documents_feed_the_text(spark):
    rows = [(1, str(i), 0.9, i, text(f"P{i}", "₹5", "1%", i / 2)) for i in range(1, 9)]
    hits = spark.createDataFrame(rows, "query_id long, doc_id string, score double, rank int, text string")
    assert answer(hits, "hello").startswith("I found 5 relevant products (sorted by reviews):\n\n**1. P5**")
    assert A.mean_scores(hits).first()["num_sources"] == 8


def test_questions_end_to_end(spark, sample_products):
    index, encoder = PT.build_index(load_and_clean(sample_products))
    rows = [(1, "t", "2024-01-01 10:00:00", "Recommend a product 7", 5), (2, "t", "2024-01-01 10:01:00", "Tell me more", 3),
            (3, "u", "2024-01-01 10:00:00", "hi", 5), (4, "u", "2024-01-01 10:00:00", "price?", 21),
            (5, "v", "2024-01-01 10:00:00", "zzzz qqqq", None)]
    asked = spark.createDataFrame(rows, "query_id long, session_id string, ts string, question string, top_k int").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    answered, rejected = PS.answer_questions(asked, index, encoder, threshold=0.05)
    got = {r["query_id"]: r for r in answered.collect()}
    assert set(got) == {1, 2, 5} and {r["query_id"] for r in rejected.collect()} == {3, 4}
    assert got[1]["answer"].startswith("Based on ratings, I recommend **")
    assert len(got[1]["sources"]) == 5 and len(got[2]["sources"]) == 3
    assert (got[1]["conversation_turns"], got[2]["conversation_turns"]) == (1, 2)
    assert got[5]["confidence"] == "low"
    some, _ = PS.answer_questions(asked.withColumn("include_sources", F.when(F.col("query_id") == 1, False)), index, encoder,
                                  threshold=0.05)
    said = {r["query_id"]: r for r in some.collect()}
    assert said[1]["sources"] is None and said[1]["num_sources"] == 5 and len(said[2]["sources"]) == 3
    pairs = A.answer_messages(answered).filter("session_id = 't'").count()
    assert pairs == 4
    none, _ = PS.answer_questions(asked, index, encoder, threshold=2.0)
    assert {(r["answer"], r["confidence"], r["num_sources"]) for r in none.collect()} == {(A.NOT_FOUND, "low", 0)}


def test_document_text(spark, sample_products):
    row = load_and_clean(sample_products).filter("product_id = 'B000000001'").select("*", X.document_text().alias("d")).first()
    assert row["d"].split("\n") == [
        "Product: Samsung Product 1", "Product ID: B000000001", "Brand: Samsung", "Category: Computers > Cables",
        f"Original Price: {row['actual_price']}", f"Sale Price: {row['discounted_price']}", "Discount: 47% off",
        "Rating: 3.1/5 (1,097 reviews)", "Description: Great product 1 with features", "Review: Nice product"]
    assert R.index_rows(load_and_clean(sample_products).withColumn("rag_document", X.document_text())).first()["discount"].endswith("%")
