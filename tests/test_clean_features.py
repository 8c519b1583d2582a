import math

from pyspark.sql import functions as F

from stallwise.operators import catalog as K
from stallwise.operators.clean import catalogue_stats, first_per_name, load_and_clean, with_texts
from stallwise.operators.features import FittedFeatures, engineer_features, label_table, mode_value
from stallwise.plans.training import prepare
from stallwise.schemas import CATEGORICAL_FEATURES, FEATURES, RAW_PRODUCT_COLUMNS, TARGET
from stallwise.session import materialise
from stallwise.sources.readers import as_raw_products, load_products, read_products


def raw(spark, rows):
    """Raw rows from dicts, in the order given."""
    table = spark.createDataFrame(
        [tuple(r.get(c) for c in RAW_PRODUCT_COLUMNS) + (i,) for i, r in enumerate(rows)],
        ", ".join(f"{c} string" for c in RAW_PRODUCT_COLUMNS) + ", place int")
    return as_raw_products(table, order="place")


def product(name, **other):
    return {"product_id": "P", "product_name": name, "category": "A|B", "actual_price": "₹10", "discounted_price": "₹5",
            "discount_percentage": "50%", "rating": "4", "rating_count": "9", **other}


def test_names_are_made_unique_before_the_filters(spark):
    rows = [product("x", actual_price="|"), product("x"), product("y"), product("y", product_id="Q"),
            product(None, product_id="N1"), product(None, product_id="N2"), product("z", product_id=None),
            product("w", discount_percentage="101%"), product("v", discount_percentage=None)]
    kept = load_and_clean(raw(spark, rows)).select("product_name", "product_id", TARGET).collect()
    assert sorted((r[0] or "", r[1], r[2]) for r in kept) == [("", "N1", 50.0), ("v", "P", 0.0), ("y", "P", 50.0)]


def test_dedupe_is_cut_before_the_shuffle(spark):
    plan = first_per_name(raw(spark, [product("x")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_statistics(spark, sample_products):
    cleaned = load_and_clean(sample_products)
    stats = catalogue_stats(cleaned).first()
    prices = [r[0] for r in cleaned.select("actual_price_clean").collect()]
    mean = sum(prices) / len(prices)
    assert stats["total_products"] == 100 and stats["unique_categories"] == 3 and stats["unique_brands"] == 5
    assert math.isclose(stats["price_std"], math.sqrt(sum((p - mean) ** 2 for p in prices) / 99))
    assert [r["products"] for r in K.category_distribution(cleaned).collect()] == [34, 33, 33]
    total, page = K.product_page(cleaned, limit=5, offset=10, category="ELECT")
    assert total.first()["total"] == 34
    assert [r["product_id"] for r in page.collect()] == [f"B0{i:08d}" for i in range(30, 45, 3)]


def test_features_and_matrix(spark, sample_products):
    cleaned = materialise(load_and_clean(sample_products), "test")
    features = materialise(engineer_features(cleaned), "test")
    rows = features.collect()
    counts = sorted(r["rating_count_clean"] for r in rows)
    median = (counts[49] + counts[50]) / 2
    for r in rows:
        assert math.isclose(r["price_log"], math.log1p(r["actual_price_clean"]))
        assert r["high_engagement"] == int(r["rating_count_clean"] > median)
        assert r["brand_popularity"] == 20
        assert math.isclose(r["engagement_score"], r["rating_clean"] * math.log1p(r["rating_count_clean"]))
    fitted, matrix = FittedFeatures.fit_transform(features, keep=["product_id", TARGET])
    figures = matrix.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    assert all(abs(figures[f"m_{c}"]) < 1e-9 for c in FEATURES)
    assert all(min(abs(figures[f"s_{c}"] - 1), abs(figures[f"s_{c}"])) < 1e-9 for c in FEATURES)
    assert len(matrix.first()["features"]) == 16
    again = fitted.transform(features, keep=["product_id", TARGET])
    assert sorted(map(str, again.select("product_id", "features").collect())) == sorted(
        map(str, matrix.select("product_id", "features").collect()))


def test_unseen_values_get_the_first_label(spark, sample_products, tmp_path):
    features = materialise(engineer_features(materialise(load_and_clean(sample_products), "t")), "t")
    fitted = FittedFeatures.fit(features)
    strange = features.limit(1).withColumns({"brand": F.lit("Nobody"), "sub_category": F.lit(None).cast("string")})
    coded = fitted.encode(strange).first()
    assert coded["brand"] == 0 and coded["sub_category"] == 0
    fitted.save(str(tmp_path / "fitted"))
    loaded = FittedFeatures.load(spark, str(tmp_path / "fitted"))
    assert loaded.scaling == fitted.scaling
    assert loaded.labels().count() == label_table(features, CATEGORICAL_FEATURES).count()


def test_mode_takes_the_smallest_on_a_tie(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "v string")
    assert mode_value(rows, "v").first()["value"] == "a"


def test_csv_by_header_with_quotes_and_breaks(spark, tmp_path):
    names = list(reversed(RAW_PRODUCT_COLUMNS))
    values = {c: c for c in names} | {
        "product_name": 'Cable, "2 m"', "about_product": "one\ntwo", "rating": "N/A", "rating_count": "24,269"}
    quoted = ",".join('"' + values[c].replace('"', '""') + '"' for c in names)
    (tmp_path / "products.csv").write_text(",".join(names) + "\n" + quoted + "\n" + quoted + "\n", encoding="utf-8")
    rows = read_products(spark, str(tmp_path / "products.csv")).orderBy("ord").collect()
    assert len(rows) == 2 and rows[0]["ord"]["row"] < rows[1]["ord"]["row"]
    assert rows[0]["product_name"] == 'Cable, "2 m"' and rows[0]["about_product"] == "one\ntwo"
    assert rows[0]["rating"] is None and rows[0]["category"] == "category"
    assert load_and_clean(load_products(spark, str(tmp_path / "products.csv"))).count() == 0  # no price


def test_a_column_without_any_value(spark, sample_products):
    features = engineer_features(load_and_clean(sample_products)).withColumn("brand", F.lit(None).cast("string"))
    fitted, matrix = FittedFeatures.fit_transform(materialise(features, "features"))
    assert fitted.labels("brand").count() == 0 and "brand" not in fitted.fills
    assert matrix.count() == 100 and matrix.select("brand").distinct().count() == 1


def test_saved_features_keep_the_catalogue_figures(spark, sample_products, tmp_path):
    prepared = prepare(sample_products)
    prepared.fitted.save(str(tmp_path / "a"))
    again = FittedFeatures.load(spark, str(tmp_path / "a"))
    assert again.catalogue.collect() == catalogue_stats(prepared.cleaned).collect()
    again.catalogue = None
    again.save(str(tmp_path / "b"))
    assert FittedFeatures.load(spark, str(tmp_path / "b")).catalogue is None


def test_keyed_texts_equal_joined_texts_and_stay_out_of_the_cleaned_table(spark):
    rows = [product(f"n{i % 7}", product_id=f"P{i}") for i in range(20)] + [product(None, product_id="N")]
    table = raw(spark, rows).drop("about_product", "review_content")
    documents = spark.createDataFrame(
        [(i, None if i == 3 else "é" * i + "x") for i in range(6)] * 2 + [(None, "lost")], "key long, text string")
    texts = {"about_product": (F.when(F.col("ord") != 1, F.col("ord").cast("long")), documents),
             "review_content": (F.col("ord").cast("long") + 3, documents)}
    once = documents.distinct()
    about, review = (once.select(F.col("key").alias(k), F.col("text").alias(c))
                     for k, c in (("a", "about_product"), ("r", "review_content")))
    joined = table.join(about, (F.col("a") == F.col("ord")) & (F.col("ord") != 1), "left").join(
        review, F.col("r") == F.col("ord") + 3, "left").drop("a", "r")
    want = load_and_clean(joined)
    slim = load_and_clean(table, texts=texts)
    assert "about_product" not in slim.columns and "review_content" not in slim.columns
    keep = [c for c in want.columns if c not in texts]
    assert sorted(slim.select(keep).collect(), key=str) == sorted(want.select(keep).collect(), key=str)
    whole = with_texts(slim, texts).select(want.columns)
    assert sorted(whole.collect(), key=str) == sorted(want.collect(), key=str) and whole.count() == 8
    begin = with_texts(slim, texts, {"about_product": 2, "review_content": 1}).select("ord", "about_product", "review_content")
    cut = want.select("ord", F.substring("about_product", 1, 2), F.substring("review_content", 1, 1))
    assert sorted(begin.collect(), key=str) == sorted(cut.collect(), key=str)


def test_the_catalogue_of_the_queries_holds_no_texts(spark):
    from stallwise.registry import queries as R

    folder = "/root/testdata/sf0.001"
    assert not {"about_product", "review_content"} & set(R.cleaned(spark, folder).columns)
