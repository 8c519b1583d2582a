"""Message log, session roll-ups and the views over them.

``messages`` has the columns ``id, session_id, role, content, ts``; time order is
``(ts, id)``.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import text as X
from stallwise.operators.joins import lookup_join
from stallwise.operators.ordered import last_rows, previous_rows, running_count

ORDER = ["ts", "id"]
MAX_HISTORY = 10
CONTEXT_MESSAGES = 6
RECENT_SESSIONS = 100
LISTED_SESSIONS = 20
SEARCH_HITS = 20
RETENTION_DAYS = 30


def sessions(messages: DataFrame) -> DataFrame:
    """Session table: first and last message time, number of messages."""
    return messages.groupBy("session_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_activity"),
        F.count("*").alias("message_count"))


def with_turns(table: DataFrame) -> DataFrame:
    return table.withColumn("turns", F.expr("message_count div 2"))


def running_sessions(messages: DataFrame) -> DataFrame:
    """State of its session after every message: count so far and last activity."""
    counted = running_count(messages, ["session_id"], ORDER, "message_count", "running-sessions")
    return counted.withColumn("last_activity", F.col("ts"))


def retained(messages: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """Last ``2 * max_history`` messages of each session."""
    return last_rows(messages, ["session_id"], ORDER, 2 * max_history)


def history(messages: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """One row per session with its retained messages in time order, and the turns.

    The collected list has no more than ``2 * max_history`` items.
    """
    item = F.struct("ts", "id", "role", "content")
    return (
        retained(messages, max_history).groupBy("session_id")
        .agg(F.array_sort(F.collect_list(item)).alias("m"))
        .select(
            "session_id",
            F.transform("m", lambda m: F.struct(m["role"], m["content"], m["ts"].alias("timestamp")))
            .alias("messages"),
            F.floor(F.size("m") / 2).cast("bigint").alias("turns"))
    )


def context(messages: DataFrame, last_n: int = CONTEXT_MESSAGES) -> DataFrame:
    """Text of the last messages of each session, oldest first, below a header."""
    line = F.struct("ts", "id", X.context_line(F.col("role"), F.col("content")).alias("line"))
    return (
        last_rows(messages, ["session_id"], ORDER, last_n).groupBy("session_id")
        .agg(F.array_sort(F.collect_list(line)).alias("m"))
        .select("session_id", F.concat_ws("\n", F.lit(X.CONTEXT_HEADER), F.col("m.line")).alias("context"))
    )


def contextual_query(before: list[Column], question: Column) -> Column:
    """Last user text among the two messages before the question, then the question."""
    said = F.coalesce(*[F.when(m["role"] == "user", m["content"]) for m in before])
    return F.when(said.isNotNull(), F.concat(said, F.lit(" "), question)).otherwise(question)


def contextual_queries(messages: DataFrame) -> DataFrame:
    """Every user message of the log as a question with its contextual query."""
    rows = previous_rows(messages, ["session_id"], ORDER, ["role", "content"], 2, "contextual")
    return rows.filter(F.col("role") == "user").select(
        "id", "session_id", "ts", F.col("content").alias("question"),
        contextual_query([F.col("prev_1"), F.col("prev_2")], F.col("content")).alias("query"))


def live_sessions(messages: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """Session list: full and retained counts, turns of the retained view."""
    kept = F.least(F.col("message_count"), F.lit(2 * max_history))
    return sessions(messages).withColumns({
        "retained_count": kept, "turns": F.floor(kept / 2).cast("bigint")})


def session_list(messages: DataFrame, metadata: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """Retained counts of all sessions joined with stored metadata where there is any.

    A stored count wins over the retained one, turns follow the retained messages.
    """
    counts = live_sessions(messages, max_history).select("session_id", "retained_count", "turns")
    joined = counts.join(metadata, "session_id", "left")  # one row per session on both sides
    return joined.select(
        "session_id", F.coalesce("message_count", "retained_count").alias("message_count"), "turns",
        "created_at", "last_activity")


def latest_sessions(table: DataFrame, n: int = RECENT_SESSIONS) -> DataFrame:
    return table.orderBy(F.desc("last_activity"), "session_id").limit(n)


def listed_sessions(table: DataFrame, n: int = LISTED_SESSIONS) -> DataFrame:
    return latest_sessions(table, n).select(
        "session_id", F.col("message_count").alias("msgs"),
        X.seconds_text(F.col("created_at")).alias("created"),
        X.seconds_text(F.col("last_activity")).alias("last_active"))


def recent_session_messages(messages: DataFrame, n: int = RECENT_SESSIONS) -> DataFrame:
    """Messages and metadata of the latest ``n`` sessions; Spark broadcasts them where their measured size allows."""
    return messages.join(latest_sessions(sessions(messages), n), "session_id")


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    """One session in time order; the filter reaches the Parquet scan."""
    return messages.filter(F.col("session_id") == session_id).orderBy(*ORDER)


def message_preview(messages: DataFrame, session_id: str) -> DataFrame:
    return session_messages(messages, session_id).select(
        "role", F.substring("content", 1, 80).alias("message"), X.seconds_text(F.col("ts")).alias("time"))


def search(messages: DataFrame, term: str, n: int = SEARCH_HITS) -> DataFrame:
    """Newest messages that contain the term; A-Z match a-z, other letters only themselves. ``%`` and ``_`` match as
    in LIKE, a backslash is a plain character."""
    folded = term.translate(str.maketrans(ascii_uppercase, ascii_lowercase)).replace("\\", "\\\\")
    return (
        messages.filter(F.translate("content", ascii_uppercase, ascii_lowercase).like(f"%{folded}%"))
        .orderBy(F.desc("ts"), F.desc("id")).limit(n)
        .select("session_id", "role", F.substring("content", 1, 100).alias("message_preview"),
                X.seconds_text(F.col("ts")).alias("time"))
    )


def most_active(messages: DataFrame, n: int = 10) -> DataFrame:
    counts = messages.groupBy("session_id").agg(F.count("*").alias("msg_count"))
    return counts.orderBy(F.desc("msg_count"), "session_id").limit(n)


def store_totals(messages: DataFrame) -> DataFrame:
    """Four named figures as text, from one pass over the session roll-up.

    Text and numbers share the ``value`` column, hence the casts.
    """
    totals = sessions(messages).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("m"),
        F.min_by("session_id", F.struct(-F.col("message_count"), F.col("session_id"))).alias("who"))
    average = F.try_divide(F.col("m"), F.col("n")).cast("bigint").cast("string")
    return totals.select(F.inline(F.array(
        F.struct(F.lit("Total Sessions").alias("metric"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("Total Messages").alias("metric"), F.col("m").cast("string").alias("value")),
        F.struct(F.lit("Avg Messages/Session").alias("metric"), average.alias("value")),
        F.struct(F.lit("Most Active Session").alias("metric"), F.col("who").alias("value")),
    )))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of the row counts of named tables."""
    out = None
    for name, table in tables.items():
        row = table.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def expired_sessions(table: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return table.filter(F.col("last_activity") < now - F.make_dt_interval(F.lit(days)))


def without_sessions(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages of all sessions but the given ones."""
    keys = gone.select("session_id").distinct()
    return lookup_join(messages, keys, "session_id", "id", how="left_anti")


def apply_retention(messages: DataFrame, now: Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(messages kept, sessions kept) once expired sessions are gone."""
    table = sessions(messages)
    gone = expired_sessions(table, now, days)
    return without_sessions(messages, gone), table.join(gone.select("session_id"), "session_id", "left_anti")


def clear_sessions(messages: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages left, live view), where cleared sessions stay listed with count 0."""
    left = without_sessions(messages, named)
    view = (
        sessions(messages).join(named.select("session_id").distinct().withColumn("_cleared", F.lit(True)),
                                "session_id", "left")
        .withColumn("message_count", F.when(F.col("_cleared"), 0).otherwise(F.col("message_count")))
        .drop("_cleared")
    )
    return left, view


def add_messages(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new messages at its end."""
    return log.unionByName(new)
