import datetime as dt

import pytest
from pyspark.sql import functions as F

from stallwise.operators import answers as A, conversations as C
from stallwise.schemas import MESSAGE


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.fixture(scope="module")
def log(spark):
    rows = [(i, "long", "user" if i % 2 == 0 else "assistant", f"m{i} " + "x" * 250, at(i)) for i in range(31)]
    rows += [(100, "s", "user", "Hello", at(5)), (101, "s", "assistant", "Hi!", at(6))]
    rows += [(200, "odd", "system", "rules", at(7)), (201, "odd", "user", "one", at(8)), (202, "odd", "user", "two", at(8))]
    return spark.createDataFrame(rows, MESSAGE)


def test_roll_up_and_counts(log):
    table = {r["session_id"]: r for r in C.live_sessions(log).collect()}
    assert (table["long"]["message_count"], table["long"]["retained_count"], table["long"]["turns"]) == (31, 20, 10)
    assert (table["s"]["created_at"], table["s"]["last_activity"]) == (at(5), at(6))
    assert [r["session_id"] for r in C.most_active(log, 2).collect()] == ["long", "odd"]
    totals = {r["metric"]: r["value"] for r in C.store_totals(log).collect()}
    assert totals == {"Total Sessions": "3", "Total Messages": "36", "Avg Messages/Session": "12",
                      "Most Active Session": "long"}


def test_history_and_context(log):
    rows = {r["session_id"]: r for r in C.history(log).collect()}
    assert len(rows["long"]["messages"]) == 20 and rows["long"]["messages"][0]["content"].startswith("m11 ")
    assert [m["role"] for m in rows["s"]["messages"]] == ["user", "assistant"]
    texts = {r["session_id"]: r["context"] for r in C.context(log).collect()}
    assert texts["s"] == "Previous conversation:\nUser: Hello\nAssistant: Hi!"
    assert texts["odd"].split("\n")[1] == "Assistant: rules"
    lines = texts["long"].split("\n")
    assert len(lines) == 7 and lines[1].endswith("...") and len(lines[1]) == len("Assistant: ") + 203
    assert "nobody" not in texts


def test_contextual_queries(log):
    got = {r["id"]: r["query"] for r in C.contextual_queries(log).collect()}
    assert got[100] == "Hello" and got[201] == "one" and got[202] == "one two"
    assert got[2] == "m0 " + "x" * 250 + " m2 " + "x" * 250


def test_search_and_preview(log):
    assert [r["message_preview"] for r in C.search(log, "HELLO").collect()] == ["Hello"]
    assert C.search(log, "x").count() == 20
    assert [r["message"] for r in C.message_preview(log, "odd").collect()] == ["rules", "one", "two"]
    assert C.message_preview(log, "s").first()["time"] == "2024-01-01 00:05:00"


def test_session_filter_reaches_the_scan(spark, log, tmp_path):
    from stallwise.sources import stores

    stores.write_clustered(log, str(tmp_path / "log"))
    rows = C.session_messages(stores.read_messages(spark, str(tmp_path / "log")), "s")
    assert "EqualTo(session_id,s)" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 2
    stores.append_messages(log.filter("session_id = 's'"), str(tmp_path / "log"))
    assert C.session_messages(stores.read_messages(spark, str(tmp_path / "log")), "s").count() == 4


def test_retention_and_clearing(spark, log):
    now = F.lit(at(36) + dt.timedelta(days=30)).cast("timestamp_ntz")
    kept, table = C.apply_retention(log, now - F.expr("interval 7 minutes"))
    assert {r["session_id"] for r in table.collect()} == {"long"}
    assert kept.count() == 31
    left, view = C.clear_sessions(log, spark.createDataFrame([("long",)], "session_id string"))
    assert left.count() == 5
    assert {r["session_id"]: r["message_count"] for r in view.collect()} == {"long": 0, "s": 2, "odd": 3}


def test_questions_in_one_batch_see_each_other(spark, log):
    rows = [(900, "s", "Any cables?", at(50)), (901, "s", "Cheaper?", at(51)), (902, "new", "Hi there", at(50))]
    asked = spark.createDataFrame(rows, "query_id long, session_id string, question string, ts timestamp_ntz")
    got = {r["query_id"]: (r["query"], r["conversation_turns"]) for r in A.question_sequence(asked, log).collect()}
    assert got == {900: ("Hello Any cables?", 2), 901: ("Any cables? Cheaper?", 3), 902: ("Hi there", 1)}


def test_search_folds_ascii_letters_only(spark):
    said = ["ÖL und ESSIG", "öl UND essig", "a\\b", "a%b"]
    rows = [(i, "s", "user", text, at(i)) for i, text in enumerate(said)] + [(9, "s", "user", None, at(9))]
    table = spark.createDataFrame(rows, MESSAGE)

    def found(term):
        return [said.index(r["message_preview"]) for r in C.search(table, term).collect()]
    assert (found("essig"), found("öl"), found("ÖL"), found("a\\b"), found("A_B")) == ([1, 0], [1], [0], [2], [3, 2])
