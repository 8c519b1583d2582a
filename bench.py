"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query
starts from the given tables, writes its whole result to a no-op sink and is timed
as the median of three runs after a warm-up; the queries that fit 200 trees run once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from stallwise.operators import conversations as C, monitoring as M, retrieval as R
from stallwise.operators.clean import load_and_clean
from stallwise.operators.catalog import category_distribution
from stallwise.plans import monitoring as PM, serving as PS, training as PT
from stallwise.registry import queries as Q
from stallwise.session import build_session, scratch_path
from stallwise.sources import adapters as T
from stallwise.streaming import sessions as SS

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    state: dict = {}

    def prepare():
        state["prepared"] = PT.prepare(T.raw_products(spark, FOLDER))

    def build_index():
        state["index"] = PT.build_index(state["prepared"].cleaned)

    def train():
        state["model"] = PT.train(state["prepared"])

    def validate():
        sink(state["model"].cross_validate(state["prepared"].matrix, "product_id", held_out=state["model"]))

    def score():
        sink(PS.score_catalogue(state["prepared"].matrix, state["model"]))

    def serve():
        p = state["prepared"]
        sink(PS.predict_discounts(T.product_requests(spark, FOLDER), p.fitted, state["model"])[0])

    def answer():
        index, encoder = state["index"]
        sink(PS.answer_questions(T.questions(spark, FOLDER), index, encoder, threshold=0.0)[0])

    def report():
        events = T.metric_events(spark, FOLDER)
        before, _ = T.split_predictions(events)
        sink(PM.report(events, before, F.lit(Q.NOW).cast("timestamp_ntz")))

    def stream():
        path, check = scratch_path(spark, "bench"), scratch_path(spark, "bench-checkpoint")
        SS.roll_up(Q.stream_of(spark, T.messages(spark, FOLDER), "bench-messages"), path, check).awaitTermination()
        sink(SS.latest(spark, path, ["session_id"]))

    vectors = T.table(spark, FOLDER, "embeddings")
    timed = {
        "category_distribution": lambda: sink(category_distribution(
            load_and_clean(T.raw_products(spark, FOLDER, with_text=False)))),
        "clean_with_text": lambda: sink(load_and_clean(T.raw_products(spark, FOLDER))),
        "prepare_features": prepare,
        "build_index": build_index,
        "vector_top_k": lambda: sink(R.top_k(vectors, vectors, 5, query_id="vec_id", doc_id="vec_id")),
        "answer_questions": answer,
        "session_rollup": lambda: sink(C.sessions(T.messages(spark, FOLDER))),
        "session_context": lambda: sink(C.context(T.messages(spark, FOLDER))),
        "contextual_queries": lambda: sink(C.contextual_queries(T.messages(spark, FOLDER))),
        "latency_stats": lambda: sink(M.latency_stats(T.metric_events(spark, FOLDER))),
        "exported_metrics": lambda: sink(M.exported_metrics(T.metric_events(spark, FOLDER))),
        "monitoring_report": report,
        "stream_session_rollup": stream,
    }
    once = {} if os.environ.get("BENCH_SKIP_TRAIN") else {"train_200_trees": train, "cross_validate_200_trees": validate}
    after = {"score_catalogue": score, "serve_requests": serve} if once else {}

    seconds: dict[str, float] = {}

    def measure(name, run, runs) -> None:
        if runs > 1:
            run()
        taken = []
        for _ in range(runs):
            start = time.time()
            run()
            taken.append(time.time() - start)
        seconds[name] = round(statistics.median(taken), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)

    for name, run in timed.items():
        measure(name, run, RUNS)
    for name, run in once.items():
        measure(name, run, 1)
    for name, run in after.items():
        measure(name, run, RUNS)

    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
        "quality": {k: round(v, 4) for k, v in state["model"].metrics.items()} if once else {}}))
    spark.stop()


if __name__ == "__main__":
    main()
