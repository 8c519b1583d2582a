import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import retrieval as R


def frame(spark, vectors, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def brute(queries, docs, k):
    q = queries / (np.linalg.norm(queries, axis=1, keepdims=True) + 1e-10)
    d = docs / (np.linalg.norm(docs, axis=1, keepdims=True) + 1e-10)
    scores = np.round(q @ d.T, 12)
    return {(i, int(j), r + 1) for i in range(len(q))
            for r, j in enumerate(np.lexsort((np.arange(len(d)), -scores[i]))[:k])}


@pytest.mark.parametrize("block_bytes", [R.BLOCK_BYTES, 600])
def test_top_k_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(3)
    docs = rng.normal(size=(3000, 8)).astype("float32").astype("float64")
    docs[::3] = docs[0]  # a third of all documents are copies
    docs[7] = 0.0
    queries = np.vstack([rng.normal(size=(20, 8)), docs[:1], docs[7:8]]).astype("float32").astype("float64")
    hits = R.top_k(frame(spark, queries, "query_id"), frame(spark, docs, "id").repartition(7), 6, block_bytes=block_bytes)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in hits.collect()} == brute(queries, docs, 6)


def test_small_score_matrices(spark, monkeypatch):
    monkeypatch.setattr(R, "SCORE_CELLS", 50)
    table = np.random.default_rng(5).normal(size=(200, 4)).astype("float32").astype("float64")
    hits = R.top_k(frame(spark, table[:20], "query_id"), frame(spark, table, "id"), 4)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in hits.collect()} == brute(table[:20], table, 4)


def test_reference_case(spark):
    docs = frame(spark, np.eye(4)[:3], "id").withColumn("id", (F.col("id") + 1).cast("string"))
    query = frame(spark, [[0.9, 0.1, 0, 0]], "query_id")
    hits = R.top_k(query, docs, 2).orderBy("rank").collect()
    assert [h["doc_id"] for h in hits] == ["1", "2"]
    one = R.search_one(docs, [0.9, 0.1, 0, 0], 2).collect()
    assert [h["doc_id"] for h in one] == ["1", "2"] and abs(one[0]["score"] - hits[0]["score"]) < 1e-6
    assert R.top_k(query, docs, 20).count() == 3  # no more than there are
    assert R.retrieve(R.top_k(query, docs, 3), 0.3).count() == 1


def test_nothing_to_search(spark):
    empty = frame(spark, [[1.0]], "id").limit(0)
    some = frame(spark, [[1.0, 2.0]], "query_id")
    assert R.top_k(some, empty.select("id", "embedding"), 3).count() == 0
    assert R.top_k(some.limit(0), frame(spark, [[1.0, 2.0]], "id"), 3).count() == 0


def test_no_pairs_are_built(spark):
    docs = frame(spark, np.eye(4), "id")
    plan = R.top_k(frame(spark, np.eye(4), "query_id"), docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_text_vectors(spark):
    docs = spark.createDataFrame([("a", "red usb cable"), ("b", "blue steel kettle"), ("c", None)], "id string, text string")
    encoder = R.fit_encoder(docs)
    vectors = R.encode(docs, encoder)
    assert {len(r["embedding"]) for r in vectors.collect()} == {384}
    asked = R.encode(spark.createDataFrame([(1, "usb cable")], "query_id long, text string"), encoder)
    assert R.top_k(asked, vectors, 1).first()["doc_id"] == "a"
    own = R.encode_with(docs.na.fill(""), lambda s: s.map(lambda t: [float(len(t)), 1.0]))
    assert own.filter("id = 'a'").first()["embedding"] == [13.0, 1.0]


def test_top_k_leaves_out_broken_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, [None, 1.0]), (6, [])]
    table = spark.createDataFrame(rows, "id long, embedding array<float>")
    hits = R.top_k(table, table, 3, query_id="id")
    assert {(r["query_id"], r["doc_id"]) for r in hits.collect()} == {(1, 1), (1, 3), (3, 3), (3, 1)}


def test_a_task_holds_few_scores_however_many_queries(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(5)
    queries, docs = rng.normal(size=(20_000, 16)), rng.normal(size=(1500, 16)).astype("float32")
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    run = R._partition_top_k(SimpleNamespace(value=(np.arange(len(queries)), queries)), 4, out.field(1), out)
    batch = pa.record_batch([pa.array(range(len(docs))), pa.array(list(docs), pa.list_(pa.float32()))], names=["id", "v"])
    tracemalloc.start()
    found = [pair for b in run([batch]) for pair in zip(*(c.to_pylist() for c in b.columns)) if pair[0] < 200]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # one matrix of all queries took several times 67 MB
    assert {(q, d) for q, d, _ in found} == {(q, d) for q, d, _ in brute(queries[:200], docs.astype("float64"), 4)}


def test_hits_of_few_partitions_meet(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = rng.normal(size=(600, 6)).astype("float32").astype("float64")
    parts, ranked = [], R.first_rows
    monkeypatch.setattr(R, "first_rows", lambda df, *given: parts.append(df.rdd.getNumPartitions()) or ranked(df, *given))
    hits = R.top_k(frame(spark, docs[:9], "query_id"), frame(spark, docs, "id").repartition(200, "id"), 3)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in hits.collect()} == brute(docs[:9], docs, 3)
    assert parts[0] <= max(R.CORE_PARTITIONS * spark.sparkContext.defaultParallelism, R.LEAST_PARTITIONS)


def test_close_scores_keep_their_order(spark):
    """Scores that single precision can't tell apart, and many that are equal."""
    rng = np.random.default_rng(9)
    docs = np.ones((4000, 5)) + rng.integers(0, 9, size=(4000, 5)) * 2.0 ** -22
    docs[::50] = rng.normal(size=(80, 5))
    docs = docs.astype("float32").astype("float64")
    hits = R.top_k(frame(spark, docs[:40], "query_id"), frame(spark, docs, "id").repartition(2), 7)
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in hits.collect()} == brute(docs[:40], docs, 7)
