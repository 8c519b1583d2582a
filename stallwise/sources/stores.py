"""Stored tables: message log, product index, reports and run logs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.operators import conversations as C
from stallwise.schemas import MESSAGE


def write_clustered(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Message log laid out by (session, time), in place of an index.

    Range partitioning cuts a very large session over several files, and the
    min/max of each file let a session read skip the others.
    """
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["session_id", "ts", "id"]
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
    messages.select(*columns).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def append_messages(messages: DataFrame, path: str) -> None:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
    messages.select(*columns).write.mode("append").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).parquet(path)


def replace_messages(kept: DataFrame, path: str) -> None:
    """Write the messages that remain after a deletion to a new place."""
    write_clustered(kept, path, mode="errorifexists")


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Append with ``mode="append"``: new files only, nothing is rebuilt."""
    index.write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_retrieval(folder: str, index: DataFrame, encoder: PipelineModel, messages: DataFrame, stats: DataFrame) -> None:
    """Index, encoder, conversations and the statistics row in one folder."""
    write_index(index, f"{folder}/index")
    encoder.write().overwrite().save(f"{folder}/encoder")
    write_clustered(messages, f"{folder}/messages")
    write_json_row(stats, f"{folder}/stats")


def load_retrieval(spark: SparkSession, folder: str) -> tuple[DataFrame, PipelineModel, DataFrame, DataFrame]:
    return (read_index(spark, f"{folder}/index"), PipelineModel.load(f"{folder}/encoder"),
            read_messages(spark, f"{folder}/messages"), spark.read.json(f"{folder}/stats"))


def write_json_row(row: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def append_run(run: DataFrame, path: str) -> None:
    run.coalesce(1).write.mode("append").parquet(path)


def session_table(spark: SparkSession, path: str) -> DataFrame:
    return C.sessions(read_messages(spark, path))
