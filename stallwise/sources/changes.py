"""Changed rows of a keyed table: a bucketed snapshot, the batches since, and a manifest that names both.

Batches append what they changed. A merge writes the buckets that have changed rows
anew and then one manifest row set, which is what readers go by: a merge that stops
before it leaves the table as it was. Readers list the batches since the last merge
only, however many came before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.sources import versions

MANIFEST = "version int, bucket int, folder string"
BATCH, BUCKET, GONE = "_batch", "_bucket", "_gone"


class ChangeTable:
    """Rows with one current state per key, written by one writer at a time.

    ``schema`` is that of the rows, keys included. A row written with ``gone`` true takes its key out. A batch that is
    written again replaces itself or is merged twice, which changes nothing: rows are whole states, and of a key the
    one of the latest batch counts. Keys must be unique within a batch.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str | T.StructType, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.stored = T.StructType([*self.schema.fields, T.StructField(GONE, T.BooleanType()),
                                    T.StructField(BATCH, T.LongType())])

    def version(self) -> int:
        """Number of the last finished merge; 0 before the first."""
        return self._manifest()[0]

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """(version, folder of each bucket): as many rows as buckets, whatever the table holds."""
        at = f"{self.path}/manifest"
        version = max(versions.numbers(self.spark, at), default=0)
        if not version:
            return 0, {}
        rows = self.spark.read.schema(MANIFEST).json(f"{at}/version={version}").collect()
        return version, {r["bucket"]: r["folder"] for r in rows}

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Add the states of one batch. ``rows`` may have a boolean column ``gone``."""
        gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*columns, gone.alias(GONE), F.lit(batch).cast("long").alias(BATCH), self._bucket()).write.mode(
            "overwrite").partitionBy(BUCKET).parquet(f"{self.path}/delta/since={self.version()}/batch={batch}")

    def _since(self, version: int) -> DataFrame | None:
        at = f"{self.path}/delta/since={version}"
        if not versions.exists(self.spark, at):
            return None
        folders = [T.StructField("batch", T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        return self.spark.read.schema(T.StructType([*self.stored.fields, *folders])).parquet(at)

    def _snapshot(self, folders: dict[int, str]) -> DataFrame | None:
        if not folders:
            return None
        paths = [f"{folder}/{BUCKET}={bucket}" for bucket, folder in sorted(folders.items())]
        return self.spark.read.schema(self.stored).parquet(*paths)

    def _latest(self, parts: list[DataFrame | None]) -> DataFrame:
        rows = self.spark.createDataFrame([], self.stored)
        for part in parts:
            if part is not None:
                rows = rows.unionByName(part.select(*self.stored.names))
        values = [c for c in self.stored.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("_s"))
        return newest.select(*self.keys, "_s.*").where(f"NOT {GONE}").select(*self.stored.names)

    def read(self, through: int | None = None) -> DataFrame:
        """The current row of every key; with ``through``, without the batches after that one that aren't merged."""
        version, folders = self._manifest()
        since = self._since(version)
        if since is not None and through is not None:
            since = since.where(F.col("batch") <= through)
        return self._latest([self._snapshot(folders), since]).select(*self.schema.names)

    def merge(self) -> int:
        """Fold the batches since the last merge into the snapshot; the new version.

        Buckets without changed rows stay where they are. Files of older versions are left for readers that still
        use them.
        """
        version, folders = self._manifest()
        since = self._since(version)
        if since is None:
            return version
        touched = sorted(r[0] for r in since.select(BUCKET).distinct().collect())  # at most the number of buckets
        old = self._snapshot({b: f for b, f in folders.items() if b in touched})
        folder = f"{self.path}/snapshot/{version + 1}-{uuid.uuid4().hex}"
        self._latest([old, since]).withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(
            BUCKET).parquet(folder)
        here = {b: folder for b in touched if versions.exists(self.spark, f"{folder}/{BUCKET}={b}")}  # a bucket may be empty now
        links = {**{b: f for b, f in folders.items() if b not in touched}, **here}
        rows = [(version + 1, b, f) for b, f in sorted(links.items())]
        versions.publish(self.spark.createDataFrame(rows, MANIFEST), f"{self.path}/manifest", version + 1)
        return version + 1

    def clean(self) -> int:
        """Remove what only versions before the last merge need; the number of folders removed.

        For times when no reader still uses an older version.
        """
        version, folders = self._manifest()
        old = [f"{self.path}/delta/{n}" for n in versions.names(self.spark, f"{self.path}/delta")
               if int(n.split("=")[1]) < version]
        used = {f"{folder}/{BUCKET}={bucket}" for bucket, folder in folders.items()}
        for n in versions.names(self.spark, f"{self.path}/snapshot"):
            folder = f"{self.path}/snapshot/{n}"
            if folder not in folders.values():
                old.append(folder)
            else:
                old += [f"{folder}/{b}" for b in versions.names(self.spark, folder)
                        if b.startswith(f"{BUCKET}=") and f"{folder}/{b}" not in used]
        before = [n for n in versions.numbers(self.spark, f"{self.path}/manifest") if n < version]
        return versions.remove(self.spark, [*old, *(f"{self.path}/manifest/version={n}" for n in before)])
