"""Template answers to questions from their retrieved product texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import scoring as S, text as X
from stallwise.functions.parsing import first_number
from stallwise.operators.conversations import MAX_HISTORY, contextual_query
from stallwise.operators.joins import fetch_by_key
from stallwise.operators.ordered import previous_rows

# Counts, cuts and answer texts.
CONTEXT_DOCUMENTS = 5
LISTED = 5
ALTERNATIVES = 2
SHOWN_SOURCES = 3
LONG_NAME, SHORT_NAME = 50, 40
NOT_FOUND = "I couldn't find relevant products. Please try a different question."
NO_PRICE = "999999"
FIELDS = ["product", "sale_price", "discount", "rating", "brand"]


def context_records(hits: DataFrame) -> DataFrame:
    """Add ``products``: the records found in the text of a hit, in text order.

    A hit is headed by its own line, so it always gives one record at least; a
    blank line inside a description starts another, as it does for a reader of
    the joined context.
    """
    headed = F.concat(F.lit("Product "), F.col("rank").cast("string"), F.lit(":\n"), F.col("text"))
    parsed = F.transform(X.records(headed), lambda record: F.struct(
        *[X.last_value(record, name).alias(name) for name in FIELDS]))
    return hits.withColumn("products", parsed)


def question_products(hits: DataFrame) -> DataFrame:
    """(query_id, products): records of the first five hits in hit order."""
    first = context_records(hits.filter(F.col("rank") <= CONTEXT_DOCUMENTS))
    return first.groupBy("query_id").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("rank", "products"))).getField("products"))
        .alias("products"))


def _ordered(products: Column, field: str, missing: str, descending: bool) -> Column:
    """Products by the number in a field; equal numbers keep their order."""
    sign = -1 if descending else 1
    keyed = F.transform(products, lambda p, i: F.struct(
        (first_number(F.coalesce(p[field], F.lit(missing))) * sign).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda item: item["p"])


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def _name(product: Column, chars: int | None = None) -> Column:
    name = _or(product["product"], "Unknown")
    return name if chars is None else F.substring(name, 1, chars)


def _lines(products: Column, start: int, count: int, line) -> Column:
    picked = F.slice(products, start, count)
    return F.array_join(F.transform(picked, lambda p, i: line(p, (i + 1).cast("string"))), "")


def price_answer(products: Column, question: Column) -> Column:
    by_price = _ordered(products, "sale_price", NO_PRICE, descending=False)
    p = F.get(by_price, F.lit(0))
    cheapest = F.concat(
        F.lit("The most affordable option is **"), _name(p, LONG_NAME), F.lit("** at "),
        _or(p["sale_price"], "N/A"), F.lit(" ("), _or(p["discount"], "0%"), F.lit(" off). Rating: "),
        _or(p["rating"], "N/A"))
    listed = F.concat(F.lit("Here are products sorted by price:\n\n"), _lines(
        by_price, 1, LISTED, lambda q, n: F.concat(
            n, F.lit(". **"), _name(q, SHORT_NAME), F.lit("** - "), _or(q["sale_price"], "N/A"), F.lit("\n"))))
    return F.when(X.contains_any(question, X.CHEAPEST_KEYWORDS), cheapest).otherwise(listed)


def recommend_answer(products: Column) -> Column:
    by_rating = _ordered(products, "rating", "0", descending=True)
    top = F.get(by_rating, F.lit(0))
    head = F.concat(
        F.lit("Based on ratings, I recommend **"), _name(top), F.lit("**.\n\n• Price: "),
        _or(top["sale_price"], "N/A"), F.lit(" ("), _or(top["discount"], "N/A"), F.lit(")\n• Rating: "),
        _or(top["rating"], "N/A"), F.lit("\n• Brand: "), _or(top["brand"], "N/A"), F.lit("\n"))
    others = F.concat(F.lit("\n**Other options:**\n"), _lines(
        by_rating, 2, ALTERNATIVES, lambda q, n: F.concat(
            F.lit("• "), _name(q, SHORT_NAME), F.lit(" - "), _or(q["rating"], "N/A"), F.lit("\n"))))
    return F.when(F.size(products) > 1, F.concat(head, others)).otherwise(head)


def discount_answer(products: Column) -> Column:
    by_discount = _ordered(products, "discount", "0%", descending=True)
    return F.concat(F.lit("Best discount deals:\n\n"), _lines(
        by_discount, 1, LISTED, lambda q, n: F.concat(
            n, F.lit(". **"), _name(q, SHORT_NAME), F.lit("** - "), _or(q["discount"], "N/A"),
            F.lit(" off (Now "), _or(q["sale_price"], "N/A"), F.lit(")\n"))))


def rating_answer(products: Column) -> Column:
    by_rating = _ordered(products, "rating", "0", descending=True)
    return F.concat(F.lit("Top-rated products:\n\n"), _lines(
        by_rating, 1, LISTED, lambda q, n: F.concat(
            n, F.lit(". **"), _name(q, SHORT_NAME), F.lit("** - ⭐ "), _or(q["rating"], "N/A"), F.lit("\n"))))


def general_answer(products: Column) -> Column:
    by_rating = _ordered(products, "rating", "0", descending=True)
    head = F.concat(F.lit("I found "), F.size(products).cast("string"),
                    F.lit(" relevant products (sorted by reviews):\n\n"))
    return F.concat(head, _lines(by_rating, 1, LISTED, lambda q, n: F.concat(
        F.lit("**"), n, F.lit(". "), _name(q), F.lit("**\n   • Price: "), _or(q["sale_price"], "N/A"),
        F.lit(" ("), _or(q["discount"], "N/A"), F.lit(")\n   • Rating: "), _or(q["rating"], "N/A"),
        F.lit("\n\n"))))


def template_answer(products: Column, question: Column) -> Column:
    kind = X.intent(question)
    return (
        F.when(F.coalesce(F.size(products), F.lit(0)) <= 0, F.lit(NOT_FOUND))
        .when(kind == "price", price_answer(products, question))
        .when(kind == "recommend", recommend_answer(products))
        .when(kind == "discount", discount_answer(products))
        .when(kind == "rating", rating_answer(products))
        .otherwise(general_answer(products))
    )


def mean_scores(hits: DataFrame) -> DataFrame:
    """Mean score and number of all kept hits of each question."""
    return hits.groupBy("query_id").agg(
        F.avg("score").alias("mean_score"), F.count("*").alias("num_sources"))


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources) with the five shown fields; at most top_k items each."""
    item = F.struct(
        "rank", F.col("doc_id").alias("product_id"), "product_name", "price", "rating",
        F.round("score", 4).alias("score"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return listed.select("query_id", F.transform("s", lambda s: F.struct(
        s["product_id"].alias("product_id"), s["product_name"].alias("product_name"),
        s["price"].alias("price"), s["rating"].alias("rating"), s["score"].alias("score"))).alias("sources"))


def shown_sources(hits: DataFrame, n: int = SHOWN_SOURCES) -> DataFrame:
    return hits.filter(F.col("rank") <= n).withColumn("badge", S.score_label(F.col("score")))


def hit_texts(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with the index fields of their documents."""
    fields = index.select(F.col("id").alias("doc_id"), "text", "product_name", "price", "rating")
    return fetch_by_key(hits, fields, "doc_id", "query_id")


def question_sequence(questions: DataFrame, log: DataFrame | None) -> DataFrame:
    """Questions with their contextual query and the turns after they are answered.

    A question sees the messages logged before it and the earlier questions of its
    session in the same batch, each followed by its answer. Only the place of an
    answer matters for the next query, not its text.
    """
    asked = questions.select(
        "session_id", "ts", F.col("query_id").alias("id"), F.lit("user").alias("role"),
        F.col("question").alias("content"), F.lit(0).alias("part"), F.lit(True).alias("asked"))
    answered = asked.withColumns({"role": F.lit("assistant"), "content": F.lit(None).cast("string"),
                                  "part": F.lit(1), "asked": F.lit(False)})
    everything = asked.unionByName(answered)
    if log is not None:
        everything = everything.unionByName(log.select(
            "session_id", "ts", "id", "role", "content", F.lit(0).alias("part"), F.lit(False).alias("asked")))
    rows = previous_rows(everything, ["session_id"], ["ts", "id", "part"], ["role", "content"], 2,
                         "questions", count_into="seen")
    return rows.filter("asked").select(
        F.col("id").alias("query_id"), "session_id", "ts", F.col("content").alias("question"),
        contextual_query([F.col("prev_1"), F.col("prev_2")], F.col("content")).alias("query"),
        F.floor(F.least(F.col("seen") + 1, F.lit(2 * MAX_HISTORY)) / 2).cast("bigint")
        .alias("conversation_turns"))


def answers(asked: DataFrame, hits: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """One answer row per question.

    ``asked`` has ``query_id, session_id, question, conversation_turns``; ``hits`` are the
    kept hits with their index fields (``hit_texts``), read three times, so hand in a stored
    table. ``shown`` are the hits that become sources, all when left out. All joins are one row
    per question on both sides.
    """
    return (
        asked.join(question_products(hits), "query_id", "left")
        .join(mean_scores(hits), "query_id", "left")
        .withColumns({
            "answer": template_answer(F.col("products"), F.col("question")),
            "confidence": F.when(F.col("num_sources").isNull(), "low")
            .otherwise(S.score_label(F.col("mean_score"))),
            "num_sources": F.coalesce("num_sources", F.lit(0)),
        }).drop("products", "mean_score")
        .join(sources(hits if shown is None else shown), "query_id", "left")
    )


def answer_messages(answered: DataFrame) -> DataFrame:
    """The two log messages of every answered question, question first."""
    pair = F.inline(F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("part")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("part"))))
    return answered.select("query_id", "session_id", "ts", pair)


def query_log(answered: DataFrame) -> DataFrame:
    return answered.select("ts", "question", "session_id", "confidence")


def field_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``Key: value`` lines of every text: (key column, record, field, value), last value wins."""
    found = documents.select(key, F.posexplode(X.records(F.col(text))).alias("record", "fields"))
    lines = found.select(key, "record", F.posexplode("fields").alias("pos", "f"))
    return lines.groupBy(key, "record", F.col("f.key").alias("field")).agg(
        F.max_by("f.value", "pos").alias("value"))
