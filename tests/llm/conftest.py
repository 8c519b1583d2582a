import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} and then{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, equal texts, repeated rows, clashing further columns."""
    rows = [(1, "alpha beta gamma delta", "en", "a", 22), (2, "alpha beta gamma delta", "en", "a", 22),
            (3, "", "en", "b", 0), (4, None, None, None, None), (None, "no id here at all", "de", "b", 17),
            (None, "no id here at all", "de", "b", 17), (5, LONG, "en", "a", len(LONG)), (6, " \t\n ", None, "c", 4),
            (7, "Ünïcödé ﬁ 日本語 text 12", "fr", None, 20), (7, "Ünïcödé ﬁ 日本語 text 12", "fr", None, 20),
            (8, "one", "en", "b", 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    clash = ("id body size score row kept keep_id fp anchor block at word held held_out label group kind n_words spans "
             "items found target taken component_id text_sha256 _label _lang __id __kept __sha __sha256 __rows KEY_ID key_sha "
             "key_sha256 key_kept key_rows lead path term chunk ids n_tokens docs part").split()
    return frame.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
