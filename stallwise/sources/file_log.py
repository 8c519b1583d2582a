"""A message log whose deletions rewrite only the files that hold deleted rows.

The log is a list of files in a manifest. A deletion finds the files with rows of the
deleted sessions, writes the rest of their rows to new files and then one manifest
that names these and all untouched files. Readers go by the last finished manifest,
so a deletion that stops before it leaves the log as it was. One writer at a time.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.operators.conversations import without_sessions
from stallwise.schemas import MESSAGE
from stallwise.session import materialise
from stallwise.sources import versions

MANIFEST = "version int, folder string, file string, rows bigint"


class Deletion(NamedTuple):
    """Files left as they are, written anew and dropped whole, and rows written."""

    linked: int
    rewritten: int
    dropped: int
    rows_written: int


class FileLog:
    """Messages (``schemas.MESSAGE``) in files laid out by (session, time).

    The driver holds one manifest row per file, as Spark's own file listing does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        return max(versions.numbers(self.spark, f"{self.path}/manifest"), default=0)

    def files(self, version: int | None = None) -> dict[str, int]:
        """Rows of each file of a version, the last one if none is given."""
        version = self.version() if version is None else version
        if not version:
            return {}
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={version}").collect()
        return {f"{r['folder']}/{r['file']}": r["rows"] for r in rows}

    def _open(self, files) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], MESSAGE)
        return self.spark.read.schema(MESSAGE).parquet(*[f"{self.path}/data/{f}" for f in sorted(files)])

    def read(self, version: int | None = None) -> DataFrame:
        return self._open(self.files(version))

    def _write(self, messages: DataFrame, parts: int) -> dict[str, int]:
        """Files with rows that a write has made, and how many rows each has."""
        folder, keys = uuid.uuid4().hex, ["session_id", "ts", "id"]
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE.fields]
        messages.select(*columns).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).write.parquet(
            f"{self.path}/data/{folder}")
        written = self.spark.read.schema(MESSAGE).parquet(f"{self.path}/data/{folder}")
        counts = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows")).collect()
        return {f"{folder}/{r['file']}": r["rows"] for r in counts}

    def _publish(self, files: dict[str, int]) -> None:
        version = self.version() + 1
        rows = [(version, *f.split("/"), n) for f, n in sorted(files.items())]
        versions.publish(self.spark.createDataFrame(rows, MANIFEST), f"{self.path}/manifest", version)

    def append(self, messages: DataFrame, parts: int | None = None) -> None:
        """Add messages in at most ``parts`` new files (the session's shuffle partitions if not given)."""
        parts = parts or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._publish({**self.files(), **self._write(messages, parts)})

    def delete_sessions(self, gone: DataFrame) -> Deletion:
        """Take out all messages of the sessions in ``gone`` (``session_id``; null names none).

        Reads the session column of all files and whole rows of those that are rewritten. Without a row to delete no
        version is added.
        """
        files = self.files()
        keys = materialise(gone.select("session_id").where("session_id IS NOT NULL").distinct(), "deleted-sessions")
        # counted per file first: a session of many rows is one row per file in the join
        held = self._open(files).groupBy("session_id", F.col("_metadata.file_name").alias("file")).agg(
            F.count("*").alias("rows"))
        hit = {r["file"]: r["rows"] for r in held.join(keys, "session_id", "left_semi").groupBy("file").agg(
            F.sum("rows").alias("rows")).collect()}
        touched = {f for f in files if f.split("/")[1] in hit}
        whole = {f for f in touched if hit[f.split("/")[1]] == files[f]}
        part = touched - whole
        if not touched:
            return Deletion(len(files), 0, 0, 0)
        new = self._write(without_sessions(self._open(part), keys), len(part)) if part else {}
        self._publish({**{f: n for f, n in files.items() if f not in touched}, **new})
        return Deletion(len(files) - len(touched), len(part), len(whole), sum(new.values()))

    def clean(self) -> int:
        """Remove files and manifests that the last version doesn't name; how many they were.

        For times when no reader still uses an older version.
        """
        version, kept = self.version(), self.files()
        old = [f"{self.path}/manifest/version={n}" for n in versions.numbers(self.spark, f"{self.path}/manifest")
               if n < version]
        for folder in versions.names(self.spark, f"{self.path}/data"):
            old += [f"{self.path}/data/{folder}/{f}" for f in versions.names(self.spark, f"{self.path}/data/{folder}")
                    if f.endswith(".parquet") and f"{folder}/{f}" not in kept]
        return versions.remove(self.spark, old)
