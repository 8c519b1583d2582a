"""A corpus from raw documents: toxic ones out, one of each exact and near copy, benchmark passages out, then mixed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm.common import fold
from stallwise.llm.cube import mix
from stallwise.llm.decontaminate import contaminated, contamination
from stallwise.llm.exact_dedup import drop_exact_duplicates
from stallwise.llm.queries import CUT, table
from stallwise.llm.simhash import drop_near_duplicates
from stallwise.llm.toxicity import fit_toxicity
from stallwise.session import scratch_path, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches the cut. Texts that are null or empty stay unless the base score does."""
    model = fit_toxicity(docs.where(~fold("doc_id", 3, 1)), table(spark, sf_dir, "labels"))
    return model.keep(docs, CUT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that with the largest id."""
    return drop_exact_duplicates(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked fingerprints, that with the least id (nulls last), then digest."""
    return drop_near_duplicates(docs, length=3, bits=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rule of the contract calls contaminated."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.where(~contaminated()).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate), ("mixing", mixing)]

#: The classifier and the balanced choice have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
