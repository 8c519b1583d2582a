"""Numbered versions of a table's manifest, and files that no version in use names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    location, system = _at(spark, path)
    return system.exists(location)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    location, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(location)) if system.exists(location) else []


def remove(spark: SparkSession, paths: Iterable[str]) -> int:
    """Files or folders removed."""
    return sum(system.delete(location, True) for location, system in (_at(spark, p) for p in paths))


def numbers(spark: SparkSession, at: str) -> list[int]:
    """Versions whose manifest was finished: its last file marks that."""
    found = [n for n in names(spark, at) if n.startswith("version=")]
    return sorted(int(n.split("=")[1]) for n in found if exists(spark, f"{at}/{n}/_SUCCESS"))


def publish(rows: DataFrame, at: str, version: int) -> None:
    """A manifest as one file. What an attempt that was stopped has left there is overwritten."""
    rows.coalesce(1).write.mode("overwrite").json(f"{at}/version={version}")
