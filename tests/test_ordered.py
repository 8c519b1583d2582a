"""Ordered windows, label numbers and medians against plain Python, with one hot group."""

import random
import statistics
from collections import defaultdict

import pytest

from stallwise.operators.joins import fetch_by_key, lookup_join
from stallwise.operators.ordered import label_index, last_rows, previous_rows, running_count
from stallwise.operators.quantiles import exact_median


@pytest.fixture(scope="module")
def events(spark):
    random.seed(5)
    rows = [(("hot" if i % 3 else f"s{random.randrange(40)}"), random.randrange(50), i, f"v{i}") for i in range(3000)]
    return spark.createDataFrame(rows, "k string, ts int, id int, v string").repartition(5), rows


def grouped(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups[row[0]].append(row)
    return groups


def test_previous_rows_and_count(spark, events):
    df, rows = events
    got = previous_rows(df, ["k"], ["ts", "id"], ["v"], 2, "test", count_into="n").collect()
    want = {}
    for group in grouped(rows).values():
        for i, row in enumerate(group):
            want[row[2]] = (group[i - 1][3] if i else None, group[i - 2][3] if i > 1 else None, i + 1)
    assert {r["id"]: (r["prev_1"] and r["prev_1"]["v"], r["prev_2"] and r["prev_2"]["v"], r["n"]) for r in got} == want


def test_running_count(spark, events):
    df, rows = events
    want = {row[2]: i + 1 for g in grouped(rows).values() for i, row in enumerate(g)}
    assert {r["id"]: r["n"] for r in running_count(df, ["k"], ["ts", "id"], "n", "test").collect()} == want


def test_hot_group_spans_chunks(spark, events):
    from stallwise.operators.ordered import CHUNK, chunk

    spread = chunk(events[0], ["k"], ["ts", "id"], "test").filter("k = 'hot'").groupBy(CHUNK).count().collect()
    assert len(spread) > 3 and max(r["count"] for r in spread) < 1000


def test_last_rows(spark, events):
    df, rows = events
    got = last_rows(df, ["k"], ["ts", "id"], 4)
    want = {row[2] for g in grouped(rows).values() for row in g[-4:]}
    assert {r["id"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # cut before and after the shuffle


def test_label_index(spark):
    labels = ["b", "a", "é", "Z", "a", "", "₹", "aa"]
    rows = [("x", v) for v in labels] + [("y", f"{i:04d}") for i in range(500)]
    got = label_index(spark.createDataFrame(rows, "g string, l string"), "g", "l", "code", "test").collect()
    for group in ("x", "y"):
        distinct = sorted({v for g, v in rows if g == group}, key=lambda v: v.encode())
        assert {r["l"]: r["code"] for r in got if r["g"] == group} == {v: i for i, v in enumerate(distinct)}


@pytest.mark.parametrize("values", [
    [7], [1, 2], [1, 2, 3, 4], [5, 5, 5, 9], [-10, 3, 10**15, 2**40], list(range(100001)),
    [0, 2**62, 2**62 + 2, 2**62 + 4], [1] * 50 + [10**9] * 50,
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert exact_median(df, "v") == statistics.median(values)


def test_median_of_nothing(spark):
    assert exact_median(spark.createDataFrame([(None,)], "v long"), "v") is None


def test_lookup_join_keeps_rows(spark, events):
    df, rows = events
    lookup = spark.createDataFrame([("hot", 1), ("s3", 2)], "k string, w int")
    got = lookup_join(df, lookup, "k", "id").collect()
    assert len(got) == len(rows)
    assert all(r["w"] == {"hot": 1, "s3": 2}.get(r["k"]) for r in got)
    left = lookup_join(df, lookup.select("k"), "k", "id", how="left_anti")
    assert left.count() == sum(r[0] not in ("hot", "s3") for r in rows)
    big = spark.createDataFrame([(f"s{i}", i) for i in range(100)] + [("hot", -1)], "k string, w int")
    assert fetch_by_key(df, big, "k", "id").count() == len(rows)


def test_lookup_join_shuffles_on_the_salt(spark, events):
    """Past the broadcast threshold the hot key is spread by the salt."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lookup = spark.createDataFrame([("hot", 1), ("s3", 2)], "k string, w int")
        joined = lookup_join(events[0], lookup, "k", "id")
        assert joined.filter("w = 1").count() == sum(r[0] == "hot" for r in events[1])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and "_salt" in plan.split("hashpartitioning(", 1)[1][:60]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
