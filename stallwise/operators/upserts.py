"""A product index that takes changed products and equals one built anew.

Stored are the term counts of each product, not its weights. What an upsert brings is
compared by content hash; only new and changed products are split into words, and
document frequencies move by what came and went. Weights follow from counts and
frequencies when vectors are read, so they are always those of the whole index.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.operators.retrieval import DIMENSION
from stallwise.session import materialise
from stallwise.sources import versions
from stallwise.sources.changes import ChangeTable

COMMIT = "documents long, frequencies array<long>, schema string"
#: Upserts between two merges of the stored rows.
MERGE_EVERY = 20


def term_counts(rows: DataFrame, text: str, dimension: int = DIMENSION, into: str = "counts") -> DataFrame:
    """Hashed term counts of a text, as ``retrieval.fit_encoder`` takes them."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"), lambda w: w != "")
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension).transform(
        rows.withColumn("_words", words))
    return counted.withColumn(into, vector_to_array("_counts", "float32").cast("array<int>")).drop("_words", "_counts")


class ProductIndex:
    """Index rows with an ``id`` and a ``text``, kept below ``path`` by one writer at a time.

    An upsert writes its changes, then one commit row with the frequencies. Readers go by the last commit, so an upsert
    that stops in between has not happened, and the next one replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, dimension: int = DIMENSION,
                 buckets: int = 16):
        self.spark, self.path, self.dimension = spark, path, dimension
        if schema is None:
            schema = T.StructType.fromJson(json.loads(self._commits().orderBy(F.desc("batch")).first()["schema"]))
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        stored = T.StructType([*self.schema.fields, T.StructField("hash", T.StringType()),
                               T.StructField("counts", T.ArrayType(T.IntegerType()))])
        self.table = ChangeTable(spark, f"{path}/rows", ["id"], stored, buckets)

    def _commits(self) -> DataFrame:
        schema = T.StructType([*T._parse_datatype_string(COMMIT).fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/commits")

    def state(self) -> tuple[int, int, list[int]]:
        """(last batch, documents, in how many of them each term place occurs); batch -1 before the first."""
        if not versions.exists(self.spark, f"{self.path}/commits"):
            return -1, 0, [0] * self.dimension
        row = self._commits().orderBy(F.desc("batch")).first()
        return row["batch"], row["documents"], list(row["frequencies"])

    def _stored(self, batch: int) -> DataFrame:
        return self.table.read(through=batch)

    def changes(self, rows: DataFrame, removed: DataFrame | None, batch: int) -> DataFrame:
        """What the given rows and removed ids change, stored: kind, the new row, its counts and the old counts.

        Of rows that share an id the one with the greatest hash counts; null ids are left out. An id that is given and
        removed is given.
        """
        fields = self.schema.names
        hashed = rows.select(*fields).where("id IS NOT NULL").withColumn(
            "hash", F.sha2(F.to_json(F.struct(*fields)), 256))
        once = hashed.groupBy("id").agg(F.max_by(F.struct(*fields, "hash"), "hash").alias("row"))
        if removed is not None:
            gone = removed.select("id").where("id IS NOT NULL").distinct().join(once.select("id"), "id", "left_anti")
            once = once.unionByName(gone.withColumn("row", F.lit(None).cast(once.schema["row"].dataType)))
        before = self._stored(batch).select("id", F.col("hash").alias("old_hash"), F.col("counts").alias("old_counts"))
        both = once.join(before, "id", "left")
        kind = (F.when(F.col("row").isNull(), F.when(F.col("old_hash").isNotNull(), "removed").otherwise("unknown"))
                .when(F.col("old_hash").isNull(), "new").when(F.col("old_hash") != F.col("row.hash"), "changed")
                .otherwise("same"))
        marked = materialise(both.withColumn("kind", kind), "upsert-marked")
        encoded = term_counts(marked.where("kind IN ('new', 'changed')").withColumn("_text", F.col("row.text")), "_text",
                              self.dimension).drop("_text")
        other = marked.where("kind NOT IN ('new', 'changed')").withColumn("counts", F.lit(None).cast("array<int>"))
        return materialise(encoded.unionByName(other), "upsert-changes")

    def upsert(self, rows: DataFrame, removed: DataFrame | None = None, merge_every: int = MERGE_EVERY) -> DataFrame:
        """Take rows and drop removed ids; one row of figures: given, new, changed, same, removed, unknown, encoded."""
        batch, documents, frequencies = self.state()
        changes = self.changes(rows, removed, batch)
        figures = changes.agg(
            F.count("row").alias("given"),
            *[F.count_if(F.col("kind") == k).alias(k) for k in ("new", "changed", "same", "removed", "unknown")],
            F.count("counts").alias("encoded"))
        moved = changes.where("kind IN ('new', 'changed', 'removed')")
        gone = F.col("kind") == "removed"
        self.table.write(moved.select(
            "id", *[F.col("row")[c].alias(c) for c in self.schema.names if c != "id"], F.col("row.hash").alias("hash"),
            "counts", gone.alias("gone")), batch + 1)

        def places(counts: str, sign: int) -> DataFrame:
            used = F.filter(F.transform(counts, lambda n, i: F.when(n > 0, i)), lambda i: i.isNotNull())
            return moved.select(F.explode(used).alias("place"), F.lit(sign).alias("by"))

        delta = places("counts", 1).unionByName(places("old_counts", -1)).groupBy("place").agg(F.sum("by").alias("by"))
        for row in delta.collect():  # at most one row per place of the vector
            frequencies[row["place"]] += row["by"]
        counted = figures.first()
        self._commit(batch + 1, documents + counted["new"] - counted["removed"], frequencies)
        if (batch + 2) % merge_every == 0:
            self.table.merge()
        return self.spark.createDataFrame([counted], figures.schema)

    def _commit(self, batch: int, documents: int, frequencies: list[int]) -> None:
        self.spark.createDataFrame([(documents, frequencies, self.schema.json())], COMMIT).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def rows(self) -> DataFrame:
        """The index rows as they were given."""
        return self._stored(self.state()[0]).select(*self.schema.names)

    def vectors(self) -> DataFrame:
        """The index rows with ``embedding``: counts by inverse document frequency, of unit length."""
        batch, documents, frequencies = self.state()
        weights = F.array(*[F.lit(math.log((documents + 1) / (n + 1))) for n in frequencies])
        weighted = F.zip_with("counts", weights, lambda n, w: n * w)
        norm = F.sqrt(F.aggregate("_weighted", F.lit(0.0), lambda total, x: total + x * x))
        unit = F.transform("_weighted", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x).cast("float"))
        return self._stored(batch).withColumn("_weighted", weighted).withColumn("_norm", norm).select(
            *self.schema.names, unit.alias("embedding"))
