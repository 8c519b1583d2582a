"""Approximate top-k by cosine: vectors in cells around centroids, a few cells looked at per query.

The cells are partitions of a Parquet table, so a search reads only the folders of the
cells its queries come near. Within them every score is exact. ``retrieval.top_k``
stays the exact way; ``recall`` measures one against the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.functions import vectors as V
from stallwise.operators.ordered import first_rows
from stallwise.operators.retrieval import (
    BLOCK_BYTES,
    CORE_PARTITIONS,
    DOCUMENT_ROWS,
    LEAST_PARTITIONS,
    QUERY_ROWS,
    TOP_K,
    _Best,
    _unit_rows,
    top_k,
)
from stallwise.session import materialise, scratch_path

#: Vectors that the centroids are fitted on at most, and cells at most: what is broadcast is this many vectors.
SAMPLE, MOST_CELLS = 20_000, 4096
#: Share of the exact hits that the probe count is set for, measured on so many vectors as queries.
TARGET, TUNED_ON = 0.95, 256
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def whole(vector: str, width: int):
    """Vectors that can be compared: of the full width, without nulls."""
    return F.coalesce(F.size(vector) == width, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull())


@dataclass
class CellIndex:
    """``rows`` (the indexed rows and their ``cell``) in a folder per cell, and the centroids, one row per cell.

    ``probes`` is how many cells a query looks at unless told otherwise.
    """

    rows: DataFrame
    centroids: np.ndarray
    id: str
    vector: str
    probes: int

    def near(self, matrix: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each row of a matrix of unit vectors."""
        probes = min(probes, len(self.centroids))
        return np.argsort(-(matrix @ self.centroids.T), axis=1, kind="stable")[:, :probes]


def fit_centroids(vectors: DataFrame, id: str, vector: str, width: int, cells: int, sample: int = SAMPLE,
                  seed: int = 42) -> np.ndarray:
    """Unit centroids of a sample of at most ``sample`` vectors, chosen by a hash of the id (a top-n sort)."""
    chosen = vectors.where(whole(vector, width) & (V.l2_norm(F.col(vector)) > 0)).select(id, vector).orderBy(
        F.xxhash64(F.col(id)), id).limit(sample)
    points = materialise(chosen.select(array_to_vector(V.normalise(F.col(vector))).alias("features")), "cells-sample")
    if points.isEmpty():
        return np.zeros((1, width))
    model = KMeans(k=max(2, cells), seed=seed, maxIter=20, distanceMeasure="cosine").fit(points)
    centers = np.array(model.clusterCenters(), "float64")
    return centers / (np.linalg.norm(centers, axis=1, keepdims=True) + V.EPSILON)


def with_cell(rows: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """Every row with the number of its nearest centroid; the broadcast is cells x width numbers."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros(len(batch), "int32")
            for start in range(0, len(batch), DOCUMENT_ROWS):
                part = np.stack([np.asarray(v, "float64") for v in batch[start:start + DOCUMENT_ROWS]])
                out[start:start + len(part)] = (part @ sent.value.T).argmax(axis=1)
            yield pd.Series(out)

    return rows.withColumn("cell", cell(F.col(vector).cast("array<float>")))


def tuned_probes(index: CellIndex, k: int = TOP_K, target: float = TARGET, sample: int = TUNED_ON) -> int:
    """The least number of cells in which ``target`` of the exact hits lie, for a sample of the indexed vectors.

    At most ``sample`` vectors, chosen by a hash of the id, are searched exactly once; what comes to the driver is
    their hits. Every hit tells at which of its query's cells, from the nearest on, it would be found.
    """
    asked = materialise(index.rows.select(F.col(index.id).alias("q"), F.col(index.vector).alias("v")).orderBy(
        F.xxhash64("q"), "q").limit(sample), "cells-asked")
    hits = top_k(asked, index.rows, k, query_id="q", query_vector="v", doc_id=index.id, doc_vector=index.vector)
    placed = hits.select("query_id", F.col("doc_id").alias(index.id)).join(
        index.rows.select(index.id, "cell"), index.id).groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
    rows = asked.dropDuplicates(["q"]).join(placed, F.col("q") == F.col("query_id")).select("v", "cells").toArrow()
    if not rows.num_rows:
        return 1
    order = index.near(_unit_rows(rows.column("v").combine_chunks()), len(index.centroids))
    at = np.sort([int(np.flatnonzero(near == cell)[0]) for near, cells in zip(order, rows.column("cells").to_pylist())
                  for cell in cells])
    return int(at[max(0, math.ceil(target * len(at)) - 1)]) + 1


def build_cells(vectors: DataFrame, path: str, id: str = "id", vector: str = "embedding", cells: int | None = None,
                sample: int = SAMPLE, target: float = TARGET) -> CellIndex:
    """Index every row whose vector is whole, in folders by cell below ``path``.

    ``cells`` is the square root of the number of rows unless given; the probe count is set for a recall of ``target``
    on a sample. A cell with much of the table is split over
    several files, small ones share a task. Rows whose vector is null, holds a null or has another width than the widest
    have no hits and are left out; equal vectors share a cell; an empty table gives an index without rows.
    """
    spark = vectors.sparkSession
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    width = max(size["d"] or 1, 1)
    cells = min(cells or max(1, round(math.sqrt(size["n"]))), MOST_CELLS)
    centroids = fit_centroids(vectors, id, vector, width, cells, sample)
    placed = with_cell(vectors.where(whole(vector, width)), vector, centroids)
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(
        1).write.mode("overwrite").parquet(f"{path}/centroids")
    index = CellIndex(_rows(spark, path, vectors.schema.fields), centroids, id, vector, 1)
    index.probes = tuned_probes(index, target=target)
    spark.createDataFrame([(id, vector, index.probes)], "id string, vector string, probes int").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/settings")
    return index


def _rows(spark: SparkSession, path: str, fields: list) -> DataFrame:
    from pyspark.sql import types as T

    return spark.read.schema(T.StructType([*fields, T.StructField("cell", T.IntegerType())])).parquet(f"{path}/cells")


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    """A built index; its centroids, ``MOST_CELLS`` at most, come to the driver."""
    centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow().column("centroid")
    matrix = np.array(centroids.to_pylist(), "float64")
    settings = spark.read.parquet(f"{path}/settings").first()
    return CellIndex(spark.read.parquet(f"{path}/cells"), matrix, settings["id"], settings["vector"], settings["probes"])


class _Kept(_Best):
    """The k best (score, id) of each query of a block; places without a hit have the score -inf."""

    def __init__(self, queries: np.ndarray, k: int, text: bool):
        super().__init__(queries, k)
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), "", object) if text else np.zeros((len(queries), k), "int64")

    def offer(self, units: np.ndarray, small: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Documents as for ``_Best``, for the queries ``rows`` (ascending) or all; of equal scores the smaller id is better."""
        if rows is not None:
            some = copy(self)
            some.queries, some.small, some.scores, some.ids = (x[rows] for x in (
                self.queries, self.small, self.scores, self.ids))
            some.offer(units, small, ids)
            self.scores[rows], self.ids[rows] = some.scores, some.ids
            return
        product, floor = self.small @ small, self.scores[:, -1] - self.margin
        if len(ids) >= self.k and np.isneginf(floor).any():  # the k-th of these has no score under its own less the margin
            floor = np.fmax(floor, np.partition(product, -self.k, axis=1)[:, -self.k] - 2 * self.margin)
        self._near(product >= floor.astype("float32")[:, None], units, ids)


@dataclass
class _Looks:
    """The queries that look at each cell, ascending: those from ``starts[cell]`` on, up to ``starts[cell + 1]``."""

    queries: np.ndarray
    starts: np.ndarray

    @staticmethod
    def of(near: np.ndarray, cells: int) -> _Looks:
        order = np.argsort(near, axis=None, kind="stable")
        starts = np.searchsorted(near.ravel()[order], np.arange(cells + 1))
        return _Looks((order // near.shape[1]).astype("int32"), starts)

    def at(self, cell: int) -> np.ndarray:
        return self.queries[self.starts[cell]:self.starts[cell + 1]]


def _probe(sent, k: int, out: pa.Schema):
    """Task body: rows of some cells against the queries that look at each, or against all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, looks = sent.value
        text = pa.types.is_string(out.field(1).type)
        slices = [slice(at, at + QUERY_ROWS) for at in range(0, len(query_ids), QUERY_ROWS)]
        kept = [_Kept(matrix[part], k, text) for part in slices]
        cuts = np.arange(len(slices) + 1) * QUERY_ROWS
        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for cell in [None] if looks is None else np.unique(cells):
                own, rows, parts = batch, None, range(len(slices))
                if looks is not None:
                    rows = looks.at(cell)
                    ends = np.searchsorted(rows, cuts)
                    parts = np.flatnonzero(np.diff(ends))
                    if not len(parts):
                        continue
                    own = batch.take(pa.array(np.flatnonzero(cells == cell)))
                for start in range(0, own.num_rows, DOCUMENT_ROWS):
                    piece = own.slice(start, DOCUMENT_ROWS)
                    ids = np.asarray(piece.column(0).to_pylist(), dtype=object if text else "int64")
                    order = np.argsort(ids, kind="stable")
                    ids, units = ids[order], _unit_rows(piece.column(1))[order]
                    scored = ~np.isnan(units).any(axis=1)
                    if not scored.all():
                        ids, units = ids[scored], units[scored]
                    small = np.ascontiguousarray(units.T, dtype="float32")
                    for i in parts:
                        kept[i].offer(units, small, ids, None if rows is None else rows[ends[i]:ends[i + 1]] - cuts[i])
        for part, best in zip(slices, kept):
            query, place = np.nonzero(best.scores > -np.inf)
            yield pa.record_batch([pa.array(query_ids[part][query], out.field(0).type),
                                   pa.array(best.ids[query, place].tolist(), out.field(1).type),
                                   pa.array(best.scores[query, place])], schema=out)

    return run


def probe_top_k(queries: DataFrame, index: CellIndex, k: int = TOP_K, probes: int | None = None, *, query_id: str = "query_id",
                query_vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k most similar rows of the ``probes`` cells nearest to every query: (query_id, doc_id, score, rank).

    Scores are exact cosines and ties go to the smaller id, so with as many probes as cells the result is that of
    ``top_k``. Queries go out in blocks of bounded size; a block reads the folders of the cells that some query of it
    looks at, in as many partitions as the cores need. Queries without a whole vector have no hits.
    """
    spark = queries.sparkSession
    probes = min(probes or index.probes, len(index.centroids))
    every = probes == len(index.centroids)
    width = index.centroids.shape[1]
    asked = queries.where(whole(query_vector, width)).select(
        F.col(query_id).alias("q"), F.col(query_vector).cast("array<float>").alias("v"))
    blocks = max(1, math.ceil(asked.count() * (width * 8 + (0 if every else probes * 8)) / block_bytes))
    if blocks > 1:
        asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).repartition(
            "block"), "probe-queries")
    id_type = index.rows.schema[index.id].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {query_type}, doc_id {id_type}, score double"
    out = pa.schema([pa.field("query_id", _ARROW[query_type]), pa.field("doc_id", _ARROW[id_type]),
                     pa.field("score", pa.float64())])

    def hits(block: int):
        own = asked.where(F.col("block") == block) if blocks > 1 else asked
        table = own.select("q", "v").toArrow().combine_chunks()
        if not table.num_rows:
            return None, None
        matrix = _unit_rows(table.column("v").combine_chunks())
        looks, rows = None, index.rows
        if not every:
            near = index.near(matrix, probes)
            looks, cells = _Looks.of(near, len(index.centroids)), [int(c) for c in np.unique(near)]
            rows = rows if len(cells) == len(index.centroids) else rows.where(F.col("cell").isin(cells))
        sent = spark.sparkContext.broadcast((np.array(table.column("q").to_pylist(), object), matrix, looks))
        part = rows.select(F.col(index.id).alias("id"), F.col(index.vector).cast("array<float>").alias("v"), "cell").coalesce(
            max(CORE_PARTITIONS * spark.sparkContext.defaultParallelism, LEAST_PARTITIONS)).mapInArrow(
            _probe(sent, k, out), schema)
        return first_rows(part, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "rank"), sent

    if blocks == 1:
        found = hits(0)[0]
        return found if found is not None else spark.createDataFrame([], schema + ", rank int")
    path = scratch_path(spark, "probe-hits")
    for block in range(blocks):
        found, sent = hits(block)
        if found is not None:
            found.write.mode("append").parquet(path)
            sent.destroy()
    return spark.read.schema(schema + ", rank int").parquet(path)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact hits that were found, and how many there are."""
    both = exact.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"),
                    F.count("*").alias("hits"))
