import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import lm as L, quality as Q, toxicity as X
from stallwise.llm.common import fold
from stallwise.llm.language import fit_language
from stallwise.llm.queries import QUERIES, VOCABULARY

MIDDLE = "/root/testdata/sf0.01"


def held_accuracy(spark, name, column):
    rows = QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out")
    return rows.select(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]


def test_fold_is_crc32_of_the_decimal_text(spark):
    rows = spark.range(200).select("id", fold("id", 5, 1).alias("f")).collect()
    assert all(r["f"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 1) for r in rows)


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op2_language"](spark, MIDDLE).join(
        spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_of_odd_rows(odd, none):
    model = fit_language(odd)
    rows = {r["doc_id"]: r for r in model.predict(odd).collect()}
    assert rows[3]["language"] is None and rows[4]["language"] is None and rows[6]["language"] is None
    assert rows[7]["language"] == "fr" and all(0 <= r["score"] <= 1 for r in rows.values())
    empty = fit_language(none)
    assert empty.names == [] and empty.predict(odd).where("language is not null").count() == 0
    assert model.predict(none).count() == 0
    far = model.predict(odd.sparkSession.createDataFrame([(1, "zzzqqq xxkkjj vvwwyy" * 5)], "doc_id bigint, text string"))
    assert far.first()["rejected"]


def test_quality_and_toxicity_on_held_out_rows(spark):
    assert held_accuracy(spark, "op5_quality", "quality") > 0.87
    assert held_accuracy(spark, "op8_toxicity", "toxic") > 0.92


def test_chunks_cover_every_byte_and_overlap():
    raw = bytes(np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8))
    for n in (0, 1, 511, 512, 513, 900, 5000):
        found = Q.chunks(raw[:n], 512, 48)
        assert found.shape[1] == 512
        if n > 512:
            assert raw[:512] == found[0].tobytes() and raw[n - 512:n] == found[-1].tobytes()
            assert sum(map(len, found)) >= n and len(found) == 1 + math.ceil((n - 512) / (512 - 48))


def test_network_learns_a_byte_pattern_anywhere():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"abcdefgh "), 900)) for _ in range(300)]
    labels = np.array([i % 2 for i in range(300)])
    texts = [t[:700] + b"!!!!!" + t[705:] if y == 0 else t for t, y in zip(texts, labels)]
    parts = [Q.chunks(t, 512, 48) for t in texts[:240]]
    net = Q.train(lambda epoch: parts, labels[:240], np.ones(240), epochs=12)
    right = [(net.logit(t.decode()) > 0) == y for t, y in zip(texts[240:], labels[240:])]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("n", [1, 3, 4, 5, 10, 37, 200])
def test_epochs_see_every_chunk(n):
    found = np.arange(n)[:, None]
    seen = [Q.drawn(found, epoch, 10, 4)[:, 0].tolist() for epoch in range(10)]
    assert set().union(*seen) == set(range(n))
    assert all(len(s) == len(set(s)) >= min(4, n) and s == sorted(s) for s in seen) and max(map(len, seen)) <= max(4, -(-n // 10))


def test_quality_score_is_the_plain_convolution(spark):
    rng = np.random.default_rng(8)
    net = Q.ByteNet(rng.normal(0, 1, (3, 256, 4)).astype(np.float32), rng.normal(0, 1, 4).astype(np.float32),
                    rng.normal(0, 1, 4).astype(np.float32), 0.25, 32)
    texts = ["", None, "short", "x" * 32, "a longer text of some forty three bytes in it", "Ünïcödé " * 40]

    def plainly(text):
        raw = (text or "").encode()
        starts = [0] if len(raw) <= 32 else [*range(0, len(raw) - 32, 32 - 24), len(raw) - 32]
        logits = []
        for at in starts:
            part = raw[at:at + 32].ljust(32, b"\0")
            best = [max(sum(float(net.filters[j, part[i + j], f]) for j in range(3)) for i in range(30)) + float(net.bias[f])
                    for f in range(4)]
            logits.append(sum(max(b, 0) * float(w) for b, w in zip(best, net.weight)) + net.offset)
        return 1 / (1 + math.exp(-sum(logits) / len(logits)))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in net.score(frame).collect()}
    assert all(found[i] == pytest.approx(plainly(t), abs=1e-5) for i, t in enumerate(texts))


def test_toxicity_terms_have_no_length_bound():
    word = "x" * 30 + "".join(chr(97 + i % 26) for i in range(400)) + "tail"
    terms = X.terms_of(f" {word} ")
    assert f" {word} " in terms and word[-5:] in terms and len(terms) > 30


def test_toxicity_score_is_the_sum_over_terms(spark):
    model = X.ToxicityModel([" bad ", " ba", "adwor", " other "], np.array([1.5, -0.25, 2.0, -3.0]), -0.5)
    texts = ["BAD badword", "", None, "other, other bad!", "nothing", "xbadwordx"]

    def plainly(text):
        body = X.normal(text or "")
        total = model.offset + sum(w for t, w in zip(model.terms, model.weights) if t in body)
        return 1 / (1 + math.exp(-total))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["score"] for r in model.score(frame).collect()}
    assert found == pytest.approx({i: plainly(t) for i, t in enumerate(texts)})


def test_linear_classifier_is_the_dense_newton_solution():
    rng = np.random.default_rng(6)
    x = (rng.random((300, 40)) < 0.1).astype(float)
    target, weight = rng.random(300), rng.random(300) + 0.5
    found = X.Found([np.flatnonzero(r).tolist() for r in x], 40)
    w, offset = X.linear(found, target, weight)
    dense, hold = np.hstack([x, np.ones((300, 1))]), np.append(np.full(40, 0.05), 1e-6)
    p = 1 / (1 + np.exp(-(dense @ np.append(w, offset))))
    slope = dense.T @ ((p - target) * weight) + hold * np.append(w, offset)
    assert np.abs(slope).max() < 1e-5  # the one minimum of a convex loss


@pytest.mark.parametrize("fit", [Q.fit_quality, X.fit_toxicity])
def test_classifiers_on_odd_rows(spark, odd, none, fit):
    name = "quality" if fit is Q.fit_quality else "toxic"
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, 0), (7, None), (None, 1), (8, 1), (8, 0)],
                                   f"doc_id bigint, {name} int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 1")):
        scores = fit(odd, known).score(odd).collect()
        assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert fit(none, labels).score(none).count() == 0


def test_label_model_weighs_voters_by_accuracy():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    good = np.where(rng.random(4000) < 0.95, y, ~y).astype(int)
    poor = [np.where(rng.random(4000) < 0.55, y, ~y).astype(int) for _ in range(2)]
    copy = good.copy()
    other = np.where(rng.random(4000) < 0.9, y, ~y).astype(int)
    post = X.label_model(np.stack([good, copy, other, *poor], axis=1), np.ones(4000), 0.3)
    assert ((post > 0.5) == y).mean() > 0.93


def brute_word(word, pieces, log_p, n_pieces):
    """Sum over all segmentations, by recursion over prefixes."""
    text = L.SPACE + word
    total = [0.0] * (len(text) + 1)
    total[0] = 1.0
    for j in range(1, len(text) + 1):
        for i in range(j):
            p = pieces.get(text[i:j])
            if p is not None:
                total[j] += total[i] * math.exp(log_p[p])
            elif j == i + 1:
                total[j] += total[i] * math.exp(sum(log_p[n_pieces + b] for b in text[i:j].encode()))
    return math.log(total[-1])


def test_lattice_sums_all_segmentations_and_expectations_are_its_slopes():
    pieces, weight = L.load_pieces(VOCABULARY)
    log_p = np.log(weight / weight.sum())[:, None]
    words = ["hello", "a", "ñandú", "日本語", "\x07x", "internationalisation", "z" * 90]
    lattice = L.Lattice(words, pieces, max(map(len, pieces)))
    found = lattice.forward(lattice.weights(log_p))[lattice.last][:, 0]
    assert found == pytest.approx([brute_word(w, pieces, log_p[:, 0], len(pieces)) for w in words])
    uses = lattice.expected(lattice.weights(log_p), np.ones((len(words), 1)), len(weight))[:, 0]
    for piece in ("▁hel", "lo", "▁"):
        moved = log_p.copy()
        moved[pieces[piece]] += 1e-6
        slope = (lattice.forward(lattice.weights(moved))[lattice.last].sum() - found.sum()) / 1e-6
        assert slope == pytest.approx(uses[pieces[piece]], abs=1e-4)


def test_a_lattice_holds_every_piece_of_every_word():
    pieces = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "abab", "ba", "▁abab", "日本", "本"])}
    words = ["abab", "", "xaby", "日本a", "b" * 30, "aba\U0001f600"]
    for longest in (2, 5):
        found = L.Lattice(words, pieces, longest, L.Trie(pieces, longest))
        edges, node = set(), 0
        for text in ("▁" + w for w in words):
            for i in range(len(text)):
                own = {(node + i, node + j, pieces[text[i:j]]) for j in range(i + 1, min(len(text), i + longest) + 1)
                       if text[i:j] in pieces}
                if not any(target == node + i + 1 for _, target, _ in own):
                    own.add((node + i, node + i + 1, len(pieces) + text[i].encode()[0]))
                edges |= own
            node += len(text) + 1
        assert found.nodes == node and len(found.source) == len(edges)
        assert set(zip(found.source.tolist(), found.target.tolist(), found.piece.tolist())) == edges


def test_scores_of_a_small_corpus(spark, odd, none):
    docs = spark.createDataFrame(
        [(i, t, "en") for i, t in enumerate(["the cat sat", "The cat", "a dog", "", None, "the dog sat", "new words"])],
        "doc_id bigint, text string, lang string")
    held = F.col("doc_id") == 6
    rows = {r["doc_id"]: r for r in L.document_scores(docs, VOCABULARY, held).collect()}
    counts = {"the": 3, "cat": 2, "sat": 2, "a": 1, "dog": 2}
    n, v = sum(counts.values()) + 6, len(counts) + 1
    half = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    assert rows[0]["train_tokens"] == n and rows[0]["n_tokens"] == 4 and rows[6]["n_known"] == 1
    assert rows[0]["base_score"] == pytest.approx(half(3) + half(2) + half(2) + half(6))
    assert rows[6]["base_score"] == pytest.approx(2 * half(0) + half(6))
    assert rows[3]["base_score"] == rows[4]["base_score"] == pytest.approx(half(6))
    assert rows[0]["score"] > rows[6]["score"] and rows[6]["held_out"] and not rows[0]["held_out"]
    found = L.document_scores(odd, VOCABULARY, F.col("doc_id") == 8).collect()
    assert len(found) == odd.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert L.document_scores(none, VOCABULARY, F.lit(False)).count() == 0
    alone = L.document_scores(odd.where("doc_id = 1"), VOCABULARY, F.lit(True)).first()
    assert alone["train_tokens"] == 0 and math.isfinite(alone["score"])


def test_small_blocks_give_the_same_scores(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one, many = ({r["doc_id"]: r for r in L.document_scores(docs, VOCABULARY, fold("doc_id", 5, 1), block_bytes=b).collect()}
                 for b in (32_000_000, 20_000))
    assert one.keys() == many.keys()
    for i, r in one.items():
        assert many[i]["score"] == pytest.approx(r["score"], rel=1e-6) and many[i]["n_known"] == r["n_known"]
        assert many[i]["base_score"] == pytest.approx(r["base_score"])
    held = [r for r in one.values() if r["held_out"]]
    assert held and all(r["score"] < 0 for r in one.values())
