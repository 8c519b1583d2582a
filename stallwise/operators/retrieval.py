"""Text vectors, the product index and exact top-k by cosine."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import text as X, vectors as V
from stallwise.operators.ordered import first_rows
from stallwise.session import materialise, scratch_path

# Vector size, hit count and score threshold.
DIMENSION = 384
TOP_K = 5
THRESHOLD = 0.3
SERVING_THRESHOLD = 0.0
#: Bytes of query vectors held by every executor at a time.
BLOCK_BYTES = 64 * 1024 * 1024
#: Documents and queries scored in one matrix product, fewer documents when the matrix would have more cells than the
#: last figure. A task holds about four matrices of that size, 8 bytes a cell.
DOCUMENT_ROWS = 1024
QUERY_ROWS = 2048
SCORE_CELLS = 8 * 1024 * 1024
#: Pairs are scored one by one when they are no more than one in so many.
PAIR_SHARE = 64
#: Document partitions for each core, and at least: each sends its k best of every query to the shuffle.
CORE_PARTITIONS, LEAST_PARTITIONS = 3, 24
#: Scores are compared at this precision, so equal vectors tie and fall back to the id.
SCORE_DECIMALS = 12


# -- text vectors ------------------------------------------------------------------------

def fit_encoder(texts: DataFrame, column: str = "text", dimension: int = DIMENSION) -> PipelineModel:
    """Hashed term weights of unit length: a fixed-size, repeatable text vector.

    The fit keeps one document frequency per dimension.
    """
    words = SQLTransformer(statement=(
        f"SELECT *, filter(split(lower(coalesce({column}, '')), '(?U)\\\\W+'), w -> w <> '') AS _words "
        "FROM __THIS__"))
    return Pipeline(stages=[
        words,
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit", p=2.0),
    ]).fit(texts)


def encode(texts: DataFrame, encoder: PipelineModel, into: str = "embedding") -> DataFrame:
    vector = vector_to_array("_unit", "float32")
    return encoder.transform(texts).withColumn(into, vector).drop("_words", "_counts", "_weights", "_unit")


def encode_with(
    texts: DataFrame, encoder: Callable[[pd.Series], pd.Series], column: str = "text", into: str = "embedding"
) -> DataFrame:
    """Vectors from the user's own model, called on Arrow batches of texts."""
    return texts.withColumn(into, F.pandas_udf(encoder, "array<float>")(F.col(column)))


def index_rows(products: DataFrame, text: str = "rag_document") -> DataFrame:
    """The nine fields of an indexed product."""
    return products.select(
        F.col("product_id").alias("id"), F.col(text).alias("text"), "product_name", "brand",
        F.col("main_category").alias("category"), F.col("discounted_price").alias("price"), "actual_price",
        "rating", X.percent_text(F.col("discount_percentage")).alias("discount"))


def index_products(products: DataFrame, encoder: PipelineModel, text: str = "rag_document") -> DataFrame:
    return encode(index_rows(products, text), encoder)


def append_to_index(index: DataFrame, more: DataFrame) -> DataFrame:
    return index.unionByName(more)


# -- top-k ---------------------------------------------------------------------------------

def _unit_rows(column: pa.Array) -> np.ndarray:
    """Arrow list column to a matrix of unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    matrix = flat.reshape(len(column), -1)
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + V.EPSILON)


class _Best:
    """The k best (score, id) pairs of some queries (unit rows) seen so far in one partition.

    Scores are told apart in single precision, which is known to be within ``margin`` of the true score, and only the
    pairs that may enter are scored in double precision.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.small = queries.astype("float32")
        self.margin = (queries.shape[1] + 8) * 2.0 ** -23 + 10.0 ** (1 - SCORE_DECIMALS)
        self.scores = np.full((len(queries), 0), 0.0)
        self.ids: np.ndarray | None = None

    def offer(self, units: np.ndarray, small: np.ndarray, ids: np.ndarray) -> None:
        """``units`` are documents as rows, ``small`` as columns in single precision, ``ids`` ascending."""
        if self.ids is None or self.scores.shape[1] < self.k:
            self._whole(np.arange(len(self.queries)), units, ids)
            return
        self._near(self.small @ small >= (self.scores[:, -1] - self.margin).astype("float32")[:, None], units, ids)

    def _near(self, near: np.ndarray, units: np.ndarray, ids: np.ndarray) -> None:
        """``near`` tells the pairs that may enter."""
        places = np.flatnonzero(near)
        if not len(places):
            return
        if len(places) > near.size // PAIR_SHARE:  # many alike: the whole product is cheaper than its pairs
            self._whole(np.flatnonzero(near.any(axis=1)), units, ids)
            return
        rows, at = np.divmod(places, near.shape[1])
        step = max(1, SCORE_CELLS // 8 // self.queries.shape[1])
        exact = np.concatenate([
            np.einsum("ij,ij->i", self.queries[rows[i:i + step]], units[at[i:i + step]]) for i in range(0, len(rows), step)])
        exact = np.round(exact, SCORE_DECIMALS)
        enters = exact >= self.scores[rows, -1]
        if enters.any():
            self._pairs(rows[enters], exact[enters], ids[at[enters]])

    def _pairs(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Single pairs, ``rows`` ascending; the queries hold k pairs each."""
        k, touched = self.k, rows[np.flatnonzero(np.diff(rows, prepend=-1))]
        rows = np.concatenate([np.repeat(touched, k), rows])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, rows))
        starts = np.flatnonzero(np.diff(rows[order], prepend=-1))
        kept = order[(starts[:, None] + np.arange(k)).ravel()]
        self.scores[touched], self.ids[touched] = scores[kept].reshape(-1, k), ids[kept].reshape(-1, k)

    def _whole(self, rows: np.ndarray, units: np.ndarray, ids: np.ndarray) -> None:
        """All documents for the queries ``rows``."""
        part = np.round(self.queries[rows] @ units.T, SCORE_DECIMALS)
        # Stable, and the ids ascend: of equal scores the smallest ids stay.
        top = np.argsort(-part, axis=1, kind="stable")[:, :min(self.k, len(ids))]
        new_scores, new_ids = np.take_along_axis(part, top, axis=1), ids[top]
        if self.ids is None:
            self.scores, self.ids = new_scores, new_ids
            return
        both = np.concatenate([self.scores[rows], new_scores], axis=1)
        both_ids = np.concatenate([self.ids[rows], new_ids], axis=1)
        order = np.lexsort((both_ids, -both), axis=1)[:, : self.k]
        both = np.take_along_axis(both, order, axis=1)
        both_ids = np.take_along_axis(both_ids, order, axis=1)
        if both.shape[1] == self.scores.shape[1]:
            self.scores[rows], self.ids[rows] = both, both_ids
        else:  # still filling up, so ``rows`` are all queries
            self.scores, self.ids = both, both_ids


def _partition_top_k(queries, k: int, id_field: pa.Field, out: pa.Schema):
    """Task body: score Arrow batches of documents against a broadcast query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = queries.value
        slices = [slice(at, at + QUERY_ROWS) for at in range(0, len(query_ids), QUERY_ROWS)]
        kept = [_Best(matrix[part], k) for part in slices]
        step = max(1, min(DOCUMENT_ROWS, SCORE_CELLS // min(QUERY_ROWS, len(query_ids))))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                ids = np.asarray(piece.column(0).to_pylist())
                order = np.argsort(ids, kind="stable")
                ids, units = ids[order], _unit_rows(piece.column(1))[order]
                small = np.ascontiguousarray(units.T, dtype="float32")
                for best in kept:
                    best.offer(units, small, ids)
        for part, best in zip(slices, kept):
            if best.ids is None:
                return
            width = best.scores.shape[1]
            yield pa.record_batch([
                pa.array(np.repeat(query_ids[part], width).tolist(), type=out.field(0).type),
                pa.array(best.ids.ravel().tolist(), type=id_field.type),
                pa.array(best.scores.ravel()),
            ], schema=out)

    return run


def top_k(
    queries: DataFrame, documents: DataFrame, k: int = TOP_K, *, query_id: str = "query_id",
    query_vector: str = "embedding", doc_id: str = "id", doc_vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k most similar documents of every query: (query_id, doc_id, score, rank).

    Exact for any number of queries and documents. The queries are stored in
    blocks of bounded size; each block is sent to the executors once and every
    document partition answers it with a matrix product and its own k best, so
    neither side is shuffled and no (query, document) pair becomes a row. Only
    the partition winners meet in the final rank, from as many partitions as the cores need, not as the documents fill. Ties go to the smaller id. Queries and documents whose vector is
    null, holds a null or is not as wide as the widest query have no hits.
    """
    spark = queries.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(query_vector)).alias("d")).first()
    count, width = size["n"], size["d"] or 1

    def whole(vector: str):
        return (F.size(vector) == width) & ~F.exists(vector, lambda x: x.isNull())

    queries, documents = queries.where(whole(query_vector)), documents.where(whole(doc_vector))
    blocks = max(1, math.ceil(count * width * 8 / block_bytes))
    picked = queries.select(
        F.col(query_id).alias("_q"), F.col(query_vector).cast("array<float>").alias("_v"),
        F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"))
    if blocks > 1:
        picked = materialise(picked.repartition("_block"), "query-blocks")

    docs = documents.select(F.col(doc_id).alias("id"), F.col(doc_vector).cast("array<float>").alias("v"))
    if blocks > 1:  # read once per block, so not made once per block
        docs = materialise(docs, "query-documents")
    docs = docs.coalesce(max(CORE_PARTITIONS * spark.sparkContext.defaultParallelism, LEAST_PARTITIONS))
    id_type = docs.schema["id"].dataType
    query_type = queries.schema[query_id].dataType
    schema = f"query_id {query_type.simpleString()}, doc_id {id_type.simpleString()}, score double"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    id_field = pa.field("doc_id", arrow[id_type.simpleString()])
    out = pa.schema([pa.field("query_id", arrow[query_type.simpleString()]), id_field,
                     pa.field("score", pa.float64())])

    def block_hits(block: int):
        """(hits of one query block, its broadcast); at most about block_bytes of vectors."""
        table = picked.filter(F.col("_block") == block).select("_q", "_v").toArrow().combine_chunks()
        if not table.num_rows:
            return spark.createDataFrame([], schema + ", rank int"), None
        ids = np.asarray(table.column("_q").to_pylist())
        sent = spark.sparkContext.broadcast((ids, _unit_rows(table.column("_v").combine_chunks())))
        part = docs.mapInArrow(_partition_top_k(sent, k, id_field, out), schema)
        return first_rows(part, ["query_id"], [F.desc("score"), F.col("doc_id")], k, "rank"), sent

    if blocks == 1:
        return block_hits(0)[0]
    # A query lives in one block, so every block's result is final: it is stored and
    # its vectors are let go before the next block is sent.
    path = scratch_path(spark, "hits")
    for block in range(blocks):
        hits, sent = block_hits(block)
        hits.write.mode("append").parquet(path)
        if sent is not None:
            sent.destroy()
    return spark.read.schema(schema + ", rank int").parquet(path)


def retrieve(hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Hits at or above the threshold, cut after the top k were chosen."""
    return hits.filter(F.col("score") >= threshold)


def search_one(documents: DataFrame, vector: list[float], k: int = TOP_K, *, doc_id: str = "id",
               doc_vector: str = "embedding") -> DataFrame:
    """Top k of one query without leaving the JVM: a dot product and a top-n sort."""
    query: Column = F.array(*[F.lit(float(x)) for x in vector])
    score = V.dot(V.normalise(F.col(doc_vector)), V.normalise(query))
    scored = documents.select(F.col(doc_id).alias("doc_id"), F.round(score, SCORE_DECIMALS).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def index_stats(index: DataFrame, queries: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: documents, dimension, queries, active sessions."""
    totals = index.agg(F.count("*").alias("total_documents"), F.max(F.size("embedding")).alias("embedding_dimension"))
    return totals.withColumns({
        "total_queries": queries.agg(F.count("*").alias("n")).scalar(),
        "active_sessions": messages.agg(F.countDistinct("session_id").alias("n")).scalar(),
        "llm_enabled": F.lit(False)})
