"""Batches of prediction requests and questions, answered in one job each."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from stallwise.operators import answers as A, requests as Q, retrieval as R
from stallwise.operators.features import FittedFeatures
from stallwise.operators.model import DiscountModel
from stallwise.schemas import TARGET
from stallwise.session import materialise

RESULT_COLUMNS = ["predicted_discount", "confidence_lower", "confidence_upper", "category",
                  "explanation", "recommendation", "top_factors"]


def known_values(fitted: FittedFeatures) -> dict[str, DataFrame]:
    """Values seen in training: the label tables, not another pass over the catalogue."""
    return {c: fitted.labels(c).select(F.col("label").alias("value"))
            for c in ("main_category", "sub_category", "brand")}


def predict_discounts(
    requests: DataFrame, fitted: FittedFeatures, model: DiscountModel, key: str = "request_id",
    mode: str = "reference", catalogue: DataFrame | None = None, median: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(result rows, rejected requests with reasons)."""
    valid, rejected = Q.split_valid(Q.check_products(requests))
    rows = Q.serving_features(valid, known_values(fitted), key, mode, catalogue, median)
    scored = model.explain(fitted.transform(rows, spread=key, keep=[key]))
    return scored.select(key, *RESULT_COLUMNS), rejected


def score_catalogue(matrix: DataFrame, model: DiscountModel) -> DataFrame:
    return model.explain(matrix).select("product_id", TARGET, *RESULT_COLUMNS)


def answer_questions(
    questions: DataFrame, index: DataFrame, encoder: PipelineModel, log: DataFrame | None = None,
    threshold: float = R.THRESHOLD, include_sources: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected questions).

    ``questions`` has ``query_id, session_id, ts, question, top_k`` and may have ``include_sources``;
    the last two may differ per question. ``include_sources`` of the call stands for a question that
    doesn't say; where it is false for a question, its sources are null.
    """
    said = F.col("include_sources") if "include_sources" in questions.columns else F.lit(None).cast("boolean")
    checked = Q.check_questions(questions.withColumn("include_sources", F.coalesce(said, F.lit(include_sources))))
    valid, rejected = Q.split_valid(checked)
    asked = materialise(A.question_sequence(valid, log), "asked")
    vectors = R.encode(asked.select("query_id", F.col("query").alias("text")), encoder)
    most = valid.agg(F.max("top_k").alias("k")).first()["k"] or R.TOP_K
    hits = R.retrieve(R.top_k(vectors, index, most), threshold)
    hits = hits.join(valid.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= F.col("top_k"))
    hits = materialise(hits.drop("top_k"), "hits")
    full = materialise(A.hit_texts(hits, index), "hit-texts")
    with_sources = valid.filter("include_sources").select("query_id")
    return A.answers(asked, full, full.join(with_sources, "query_id", "left_semi")), rejected
