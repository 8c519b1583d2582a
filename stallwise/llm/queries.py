"""The registered queries of this folder: each applies its operator to its whole table and derives the columns of
the contract. Where SQL can say the result, ``ORACLE`` holds it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stallwise.llm import byte_bpe
from stallwise.llm.common import fold
from stallwise.llm.conversation_trie import prefix_trie
from stallwise.llm.cube import mix
from stallwise.llm.decontaminate import contaminated, contamination
from stallwise.llm.divergence import Divergence, ranked
from stallwise.llm.exact_dedup import exact_duplicates
from stallwise.llm.language import fit_language
from stallwise.llm.lm import document_scores
from stallwise.llm.pii import replace_personal_data
from stallwise.llm.quality import fit_quality
from stallwise.llm.simhash import hexadecimal, near_duplicates
from stallwise.llm.token_counts import token_counts
from stallwise.llm.toxicity import fit_toxicity

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A score from here on is class 1.
CUT = 0.7
TOKEN_LIMIT = 4096
#: Terms of a group in the divergence report.
TOP_TERMS = 200
#: The key of the surrogates. A deployment passes its own.
SURROGATE_KEY = "example key"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def predicted(scored: DataFrame, parts: int, rest: int) -> DataFrame:
    return scored.select("doc_id", fold("doc_id", parts, rest).alias("held_out"), "score",
                         F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def op1_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return document_scores(docs, VOCABULARY, fold("doc_id", 5, 1))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_language(docs.where(~fold("doc_id", 4, 2)))
    return model.predict(docs).select(
        "doc_id", fold("doc_id", 4, 2).alias("held_out"), F.coalesce("language", F.lit("und")).alias("lang_pred"),
        "score", "rejected")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"), digest_all=True)


def op4_cube_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    net = fit_quality(docs.where(~fold("doc_id", 4, 2)), table(spark, folder, "labels"))
    return predicted(net.score(docs), 4, 2)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts(table(spark, folder, "documents"), VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs.where(~fold("doc_id", 3, 1)), table(spark, folder, "labels"))
    return predicted(model.score(docs), 3, 1)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), length=3, bits=3)
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def op10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return replace_personal_data(table(spark, folder, "documents"), SURROGATE_KEY)


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe.encode(table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    found = found.withColumn("decoded", byte_bpe.decode(found, BYTE_RANKS))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    found = Divergence(table(spark, folder, "documents"))
    return ranked(found.pairs(), "pair").unionByName(ranked(found.terms(), "term", TOP_TERMS))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"), rebuild=True)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_lattice_lm, op2_language, op3_exact_dedup, op4_cube_mixing, op5_quality, op6_decontamination, op7_token_counts,
    op8_toxicity, op9_simhash, op10_surrogates, op11_byte_bpe, op12_source_divergence,
    op13_prefix_trie)}

#: Words of the contamination contract, in SQL: A-Z folded, then runs of word characters.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Share of a count in whole parts of 10 ** 9, exact.
_SHARE = "(1 + (1000000000::HUGEINT * ({} + 1)) // ({} + v))"

#: crc32 of a number's digits, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(CAST({} AS VARCHAR), '')],
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT FOR i IN range(8)],
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)), 4294967295::BIGINT)"""

ORACLE: dict[str, str] = {
    "op13_prefix_trie": rf"""
        WITH own AS (SELECT conv_id AS c, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''),
                                                        coalesce(text, ''))) AS tid,
                     len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
                     FROM conversations WHERE conv_id IS NOT NULL),
        numbered AS (SELECT c, tid, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, tid) AS place
                     FROM own),
        convs AS (SELECT c, c - c % 20 AS base, {_CRC.format("c")} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
        rebuilt AS (SELECT convs.c, 0 AS part, place, tid, words FROM convs JOIN numbered n ON n.c = base AND place <= h
                    UNION ALL
                    SELECT c, 1, place, tid, words FROM convs JOIN numbered USING (c) WHERE place > h),
        whole AS (SELECT c, list(tid ORDER BY part, place) AS path, list(words ORDER BY part, place) AS sizes
                  FROM rebuilt GROUP BY c),
        members AS (SELECT convs.c, coalesce(path, []) AS path, coalesce(sizes, []) AS sizes
                    FROM convs LEFT JOIN whole USING (c)),
        prefixes AS (SELECT c, d, path[1:d] AS p, sizes[d] AS words, len(path) = d AS at_end
                     FROM (SELECT c, path, sizes, unnest(range(len(path) + 1)) AS d FROM members)),
        nodes AS (SELECT d, p, min(c) AS c, count(*) AS n, coalesce(any_value(words), 0) AS words,
                         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (at_end), '')) AS ends
                  FROM prefixes GROUP BY d, p),
        children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
        full_nodes AS (SELECT nodes.*, coalesce(k, 0) AS k FROM nodes LEFT JOIN children USING (d, p)),
        below AS (SELECT a AS d, p[1:a] AS p, sum((n - 1) * words) AS saved, count_if(k = 0) AS leaves
                  FROM (SELECT *, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY ALL)
        SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, up.c AS parent_conv_id, x.n AS n_convs,
               CAST(x.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
        FROM full_nodes x JOIN below ON below.d = x.d AND below.p = x.p
        LEFT JOIN nodes up ON up.d = x.d - 1 AND up.p = x.p[1:x.d - 1]""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all({_LOWER.format("coalesce(text, '')")},
                                             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        vocabulary AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(ln) AS ltotal FROM vocabulary GROUP BY lang),
        cells AS (SELECT lang, source, term, count(*) AS n FROM t JOIN vocabulary USING (lang, term) GROUP BY ALL),
        g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, coalesce(ltotal, 0) AS ltotal
              FROM (SELECT DISTINCT lang, source FROM d)
              LEFT JOIN (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL) USING (lang, source)
              LEFT JOIN langs USING (lang)),
        grid AS (SELECT g.lang, g.source, term, ln, coalesce(n, 0) AS n, ltotal, v,
                        {_SHARE.format("coalesce(n, 0)", "total")} AS p, {_SHARE.format("ln", "ltotal")} AS q
                 FROM g JOIN vocabulary USING (lang) LEFT JOIN cells USING (lang, source, term)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
                  UNION ALL
                  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM grid WHERE n > 0 AND p > q),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
                   FROM found)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
        FROM placed WHERE part = 'pair' OR rank <= 200""",
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("text")} AS w
              FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
                      w[s:s + least(13, len(w)) - 1] AS window_words
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s
                     FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS window_words
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
                     FROM d CROSS JOIN sizes WHERE len(w) >= n)),
        hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (n, window_words)),
        reached AS (SELECT doc_id, count(DISTINCT p) AS n_hit
               FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
                  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN reached USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
