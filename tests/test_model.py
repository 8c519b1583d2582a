import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stallwise.operators import model as D, requests as Q
from stallwise.plans import serving as PS, training as PT
from stallwise.schemas import FEATURES, TARGET

SMALL = {"n_estimators": 3, "max_depth": 3}


@pytest.fixture(scope="module")
def prepared(spark, sample_products):
    return PT.prepare(sample_products)


@pytest.fixture(scope="module")
def model(prepared):
    return PT.train(prepared, "gradient_boosting", SMALL, now="2024-01-01T00:00:00")


def test_training(model):
    assert {"train_rmse", "train_mae", "train_r2", "val_rmse", "val_mae", "val_r2", "training_time"} == set(model.metrics)
    assert model.metrics["train_r2"] > 0
    rows = model.importances.orderBy("rank").collect()
    assert len(rows) == 16 and {r["feature"] for r in rows} == set(FEATURES)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
    assert model.reference_predictions.count() > 0 and model.history.count() == 1
    assert "RMSE" in PT.model_summary(model)


def random_rows(spark, n, scale):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 16)) * scale)]
    return spark.createDataFrame(rows, "id long, v array<double>").select("id", array_to_vector("v").alias("features"))


@pytest.mark.parametrize("scale", [1, 100])
def test_bounds_and_interval(spark, model, scale):
    rows = model.predict_with_interval(random_rows(spark, 50, scale)).collect()
    assert len(rows) == 50
    assert all(0 <= r["confidence_lower"] <= r["prediction"] <= r["confidence_upper"] <= 100 for r in rows)


def test_explained_rows(spark, model):
    row = model.explain(random_rows(spark, 1, 1)).first()
    assert row["predicted_discount"] == round(row["prediction"], 2)
    assert len(row["top_factors"]) == 5 and row["category"].endswith("_discount")


def test_save_and_load(spark, model, prepared, tmp_path):
    model.save(str(tmp_path), spark)
    again = D.DiscountModel.load(str(tmp_path), spark)
    assert (again.model_type, again.params, again.metrics) == (model.model_type, model.params, model.metrics)
    assert sorted(again.predict(prepared.matrix).select("product_id", "prediction").collect()) == sorted(
        model.predict(prepared.matrix).select("product_id", "prediction").collect())
    assert again.importances.count() == 16


def test_untrained_and_unknown():
    with pytest.raises(ValueError):
        D.DiscountModel().predict(None)
    with pytest.raises(ValueError):
        D.create_regressor("linear")


def test_defaults():
    boosted = D.create_regressor("xgboost")
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (200, 6, 0.1)
    assert (boosted.getSubsamplingRate(), boosted.getFeatureSubsetStrategy()) == (0.8, "0.8")
    forest = D.create_regressor("random_forest")
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (200, 10)


def test_forest_and_cross_validation(prepared):
    forest = D.DiscountModel("random_forest", {"n_estimators": 3, "max_depth": 3})
    row = forest.cross_validate(prepared.matrix, "product_id").first()
    assert len(row["cv_scores"]) == 5
    assert abs(row["cv_rmse_mean"] - np.mean(row["cv_scores"])) < 1e-9
    assert abs(row["cv_rmse_std"] - np.std(row["cv_scores"])) < 1e-9


def test_the_trained_model_stands_for_fold_0(prepared):
    fit_on, held_out = D.hash_split(prepared.matrix, "product_id")
    one = D.DiscountModel("random_forest", {"n_estimators": 3, "max_depth": 3})
    one.train(fit_on, held_out)
    row = D.DiscountModel("random_forest", {"n_estimators": 3, "max_depth": 3}).cross_validate(
        prepared.matrix, "product_id", held_out=one).first()
    own = D.regression_metrics(one.model.transform(held_out), prediction="raw_prediction", prefix="cv").first()["cv_rmse"]
    assert len(row["cv_scores"]) == 5 and abs(row["cv_scores"][0] - own) < 1e-9
    with pytest.raises(ValueError):
        D.DiscountModel("xgboost").cross_validate(prepared.matrix, "product_id", held_out=one)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.uniform(0, 90, 200), rng.uniform(0, 90, 200)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], f"{TARGET} double, prediction double")
    got = D.regression_metrics(rows, prefix="x").first()
    assert abs(got["x_rmse"] - np.sqrt(np.mean((y - p) ** 2))) < 1e-9
    assert abs(got["x_mae"] - np.mean(np.abs(y - p))) < 1e-9
    assert abs(got["x_r2"] - (1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))) < 1e-9


def test_drift(spark):
    def table(values):
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, prediction double")
    few = D.prediction_drift(table([1] * 99), table([1, 2])).first()
    assert not few["drift_detected"] and few["reason"] == "Insufficient data"
    moved = D.prediction_drift(table([9] * 100), table([1, 2])).first()
    assert moved["drift_detected"] and moved["samples_analyzed"] == 100


def test_requests(spark, prepared, model):
    rows = [(1, "Samsung TV", "Electronics|Headphones", 1000.0, 4.0, 100), (2, "Nobody Thing", "Garden|Tools", 499.0, None, None),
            (3, "Mi Band", "", 2000.0, 5.5, 10), (4, None, "A|B", -1.0, 4.0, -5), (5, "boAt x", "Home", 500.0, 2.5, 1001)]
    asked = spark.createDataFrame(rows, "request_id long, product_name string, category string, actual_price double, rating double, "
                                  "rating_count long").withColumns({"about_product": F.lit(None).cast("string"), "review_content": F.lit("ok")})
    done, rejected = PS.predict_discounts(asked, prepared.fitted, model)
    assert {r["request_id"] for r in done.collect()} == {1, 2, 5}
    assert {r["request_id"]: r["reason"] for r in rejected.collect()} == {
        3: "rating must be 0 to 5",
        4: "product_name is missing; actual_price must be 0 or more; rating_count must be 0 or more"}
    valid, _ = Q.split_valid(Q.check_products(asked))
    served = {r["request_id"]: r for r in Q.serving_features(valid, PS.known_values(prepared.fitted), "request_id").collect()}
    assert (served[2]["main_category"], served[2]["sub_category"], served[2]["brand"]) == ("Electronics", "Cables", "boAt")
    assert (served[5]["price_bucket"], served[5]["rating_bucket"], served[5]["high_engagement"]) == ("low", "average", 1)
    assert served[1]["category_popularity"] == 100 and served[2]["rating_clean"] == 4.0
    same = Q.serving_features(valid, PS.known_values(prepared.fitted), "request_id", "consistent", prepared.cleaned, 1000.0)
    same = {r["request_id"]: r for r in same.collect()}
    assert (same[5]["price_bucket"], same[1]["category_popularity"], same[2]["brand_popularity"]) == ("very_low", 34, 0)


def test_drift_without_reference_and_odd_parameters(spark):
    model = D.DiscountModel(params={"learning_rate": 1e-05, "note": "text"})
    predictions = spark.createDataFrame([(i, 40.0 + i) for i in range(150)], "n long, prediction double")
    row = model.check_drift(predictions, ["n"]).first()
    assert not row["drift_detected"] and row["reason"] == "Insufficient data"


def test_a_fit_spreads_by_rows(spark):
    rows = spark.range(0, 60_000, 1, 1).withColumn(TARGET, F.col("id") % 7)
    spread = D.packed(rows, "fit")
    sizes = [n for n in spread.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(sizes) >= 3 and max(sizes) <= 25_000
    assert spread.agg(F.countDistinct("id"), F.sum("id")).first()[:] == (60_000, 59_999 * 30_000)
    assert len(D.packed(rows.limit(500), "fit").inputFiles()) == 1
