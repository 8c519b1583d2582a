"""Cells next to the exact top k."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.operators import cells as N, retrieval as R

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet")


def rows(hits):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in hits.collect())


def test_recall_and_pruning(spark, vectors, tmp_path):
    index = N.build_cells(vectors, str(tmp_path / "i"), "vec_id")
    assert index.rows.count() == vectors.count()  # every row is indexed
    asked = vectors.where("vec_id % 20 = 0")
    exact = R.top_k(asked, vectors, 5, query_id="vec_id", doc_id="vec_id")
    found = N.probe_top_k(asked, index, 5, query_id="vec_id")
    measured = N.recall(found, exact).first()
    assert measured["hits"] == 5 * asked.count() and measured["recall"] >= 0.9
    assert index.probes < len(index.centroids)
    few = N.probe_top_k(asked.limit(1), index, 5, probes=2, query_id="vec_id")
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan
    read = index.rows.where(F.col("cell").isin([0, 1])).select(F.input_file_name()).distinct().count()
    assert 0 < read < len(index.rows.inputFiles())
    # all cells: the exact result, whatever the blocks
    whole = N.probe_top_k(asked, index, 5, probes=len(index.centroids), query_id="vec_id")
    assert rows(whole) == rows(exact)
    blocks = N.probe_top_k(asked, N.load_cells(spark, str(tmp_path / "i")), 5, probes=len(index.centroids),
                           query_id="vec_id", block_bytes=20_000)
    assert rows(blocks) == rows(exact)


def test_odd_vectors(spark, tmp_path):
    schema = "id string, embedding array<float>, extra int"
    good = [(f"d{i:03}", [float(i % 7), 1.0, float(i % 3)], i) for i in range(60)] + [("same", [1.0, 1.0, 1.0], 1)] * 3
    bad = [("null", None, 1), ("hole", [1.0, None, 2.0], 1), ("short", [1.0], 1), ("zero", [0.0, 0.0, 0.0], 1)]
    docs = spark.createDataFrame(good + bad, schema)
    index = N.build_cells(docs, str(tmp_path / "i"), cells=4)
    assert index.rows.count() == 64
    asked = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [2.0])], "query_id long, embedding array<float>")
    found = N.probe_top_k(asked, index, 4, probes=4)
    assert rows(found) == rows(R.top_k(asked.where("query_id = 1"), docs.where("size(embedding) = 3"), 4))
    assert N.probe_top_k(asked.where("query_id > 1"), index, 4).count() == 0
    empty = N.build_cells(docs.limit(0), str(tmp_path / "e"))
    assert N.probe_top_k(asked, empty, 4).count() == 0
    assert N.recall(found.limit(0), found.limit(0)).first()["recall"] == 1.0


def test_a_cell_with_most_rows_is_split(spark, tmp_path):
    rng = np.random.default_rng(0)
    near = [(i, (np.array([1.0] * 32) + rng.normal(0, 0.01, 32)).tolist()) for i in range(3000)]
    far = [(10_000 + i, rng.normal(0, 1, 32).tolist()) for i in range(300)]
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        index = N.build_cells(spark.createDataFrame(near + far, "id long, embedding array<float>").repartition(8),
                              str(tmp_path / "i"), cells=8)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = index.rows.select("cell", F.input_file_name().alias("file")).groupBy("cell").agg(
        F.count("*").alias("n"), F.countDistinct("file").alias("f"))
    assert files.orderBy(F.desc("n")).first()["f"] > 1


def probed(index_cells, queries, near, k, docs, ids, cells, out):
    """What a task finds for documents in the given order."""
    looks = None if near is None else N._Looks.of(near, index_cells)
    run = N._probe(SimpleNamespace(value=(np.array(range(len(queries)), object), queries, looks)), k, out)
    batches = [pa.record_batch([pa.array(ids[i:i + 700]), pa.array(list(docs[i:i + 700]), pa.list_(pa.float32())),
                                pa.array(cells[i:i + 700], pa.int32())], names=["id", "v", "cell"]) for i in range(0, len(docs), 700)]
    return {(q, d): s for b in run(batches) for q, d, s in zip(*(c.to_pylist() for c in b.columns))}


@pytest.mark.parametrize("text", [False, True])
def test_a_task_finds_the_best_of_the_cells_that_a_query_looks_at(text):
    rng = np.random.default_rng(4)
    docs = rng.normal(size=(2500, 6)).astype("float32")
    docs[::3] = docs[0]  # a third of all are copies
    docs[11], docs[12, 2] = 0, np.nan
    cells = rng.integers(0, 7, len(docs)).astype("int32")
    cells[100] = 7  # alone in its cell
    queries = np.vstack([rng.normal(size=(2300, 6)), docs[:1]]).astype("float64")
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    units = docs.astype("float64") / (np.linalg.norm(docs.astype("float64"), axis=1, keepdims=True) + 1e-10)
    ids = [f"d{i}" for i in range(len(docs))] if text else list(range(len(docs)))
    place = np.argsort(np.argsort(np.array(ids, object)))
    out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.string() if text else pa.int64()), ("score", pa.float64())])
    scores = np.round(queries @ units.T, 12)
    for probes in (2, 8):
        near = np.argsort(rng.random((len(queries), 8)), axis=1)[:, :probes]
        found = probed(8, queries, None if probes == 8 else near, 4, docs, ids, cells, out)
        want = {}
        for q in range(len(queries)):
            seen = np.flatnonzero(np.isin(cells, near[q]) & ~np.isnan(scores[q]))
            for d in seen[np.lexsort((place[seen], -scores[q, seen]))[:4]]:
                want[q, ids[d]] = scores[q, d]
        assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-11 for x in want)


def test_a_task_scores_few_pairs_in_double_precision(monkeypatch):
    """No sort of all scores, neither at first nor as cells follow one another, and no pass over all queries per cell."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(90, 16))
    cells = np.repeat(np.arange(90), 30).astype("int32")
    docs = (centers[cells] + rng.normal(size=(2700, 16))).astype("float32")
    queries = rng.normal(size=(4100, 16))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    sorted_cells = []
    sort = np.argsort
    monkeypatch.setattr(N.np, "argsort", lambda a, *given, **named: sorted_cells.append(np.size(a)) or sort(a, *given, **named))
    out = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    found = probed(90, queries, None, 5, docs, list(range(len(docs))), cells, out)
    assert len(found) == 5 * len(queries) and sum(sorted_cells) < len(docs) * 3


def test_hits_of_all_cells_come_from_few_partitions(spark, vectors, tmp_path, monkeypatch):
    index = N.build_cells(vectors, str(tmp_path / "i"), "vec_id", cells=60)
    parts, ranked = [], N.first_rows
    monkeypatch.setattr(N, "first_rows", lambda df, *given: parts.append(df.rdd.getNumPartitions()) or ranked(df, *given))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        asked = vectors.where("vec_id % 100 = 0")
        hits = N.probe_top_k(asked, index, 5, probes=60, query_id="vec_id")
        assert rows(hits) == rows(R.top_k(asked, vectors, 5, query_id="vec_id", doc_id="vec_id"))
        assert index.rows.rdd.getNumPartitions() > parts[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts[0] <= max(R.CORE_PARTITIONS * spark.sparkContext.defaultParallelism, R.LEAST_PARTITIONS)
