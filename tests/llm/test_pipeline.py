import corpus_pipeline

from stallwise.llm import queries as Q
from tests_llm_helpers import brute_components, brute_contamination, brute_fingerprint


def brute_run(spark, folder):
    """The stages by plain loops, given the scores of the fitted classifier."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    from stallwise.llm.common import fold
    from stallwise.llm.toxicity import fit_toxicity
    model = fit_toxicity(docs.where(~fold("doc_id", 3, 1)), Q.table(spark, folder, "labels"))
    score = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if score[r["doc_id"]] < 0.7}
    last = {}
    for i in sorted(rows):
        last[rows[i] or ""] = i
    rows = {i: rows[i] for i in last.values()}
    ids = sorted(rows)
    comp = brute_components([(i, brute_fingerprint(rows[i])) for i in ids])
    rows = {i: rows[i] for i, c in zip(ids, comp) if i == c}
    items = [tuple(r) for r in Q.table(spark, folder, "benchmark").select("item_id", "text").collect()]
    out = set()
    for i, t in rows.items():
        n, hit, _ = brute_contamination(t, items)
        if not (hit > 0 and 20 * hit >= n):
            out.add(i)
    return out


def test_run_against_brute_force(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in found} == brute_run(spark, folder)
    assert all(r["taken"] <= 2 * r["size"] for r in found)


def test_stages_on_odd_rows(spark, odd, none, folder):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, folder)
            assert out.count() <= docs.count()
            if name != "mixing":
                assert out.columns == docs.columns, name


def test_queries_return_one_row_per_document(spark, folder):
    docs = {r[0] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    for name in ("op3_exact_dedup", "op4_cube_mixing", "op6_decontamination", "op7_token_counts", "op9_simhash", "op10_surrogates"):
        rows = [r["doc_id"] for r in Q.QUERIES[name](spark, folder).collect()]
        assert sorted(rows) == sorted(docs), name


def test_queries_against_sql(spark, folder):
    import compare
    link = compare.connect(folder)
    for name, text in Q.ORACLE.items():
        assert compare.difference(Q.QUERIES[name](spark, folder), link, text) is None, name


def test_near_copies_are_told_apart_by_row(spark, folder):
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    texts = {k: " ".join(f"{k}{i * i}" for i in range(300)) for k in "ACDEF"}
    near = lambda k: texts[k].upper()  # noqa: E731  (the same folded words, another text)
    rows = [(3, near("A")), (7, texts["A"]), (7, texts["C"]), (5, texts["D"]), (5, near("D")), (None, texts["E"]),
            (None, near("E")), (None, texts["F"]), (9, near("F")), (11, None), (11, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, k int")
    left = [r["k"] for r in stage(spark, docs, folder).collect()]
    assert len(left) == 6 and {0, 2, 8} < set(left)
    for group in ({3, 4}, {5, 6}, {9, 10}):
        assert len(group & set(left)) == 1, group
