import sentencepiece
from hypothesis import given, settings, strategies as st

from stallwise.llm import decontaminate as D, token_counts as K
from stallwise.llm.queries import VOCABULARY
from tests_llm_helpers import brute_contamination

MODEL = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
RANK = K.load_ranks(VOCABULARY)
PARTS = K.chunk_pattern(RANK)


def count(text, store=None):
    store = store if store is not None else K.Chunks(RANK, 50)
    return sum(store[c] for c in PARTS.findall(K.SPACE + text.replace(" ", K.SPACE))) if text else 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdeéßж日.,_0129▁<s>"), st.characters(codec="utf-8")), max_size=60))
def test_counts_match_the_library(text):
    assert count(text) == len(MODEL.encode(text))


def test_counts_of_special_strings_and_long_runs():
    for text in ("<s> </s> <unk> <0x0A>", "a" * 3000, " " * 100, "\n" * 50, "  lead and trail  ", "x\0y", "▁▁ ▁a"):
        assert count(text) == len(MODEL.encode(text))


def test_store_forgets_but_counts_the_same():
    store = K.Chunks(RANK, 10)
    text = " ".join(f"word{i % 40}" for i in range(400))
    assert count(text, store) == len(MODEL.encode(text)) and len(store) <= 10


def test_token_counts_over_a_table(odd, none, spark, folder):
    for docs in (odd, spark.read.parquet(f"{folder}/documents.parquet")):
        found = sorted([tuple(r) for r in K.token_counts(docs, VOCABULARY).collect()], key=str)
        expected = [(r["doc_id"], len((r["text"] or "").encode()), len(MODEL.encode(r["text"] or ""))) for r in docs.collect()]
        assert found == sorted(expected, key=str)
    assert K.token_counts(none, VOCABULARY).count() == 0


def test_contamination_against_brute_force(spark, odd, none):
    item = "The quick brown fox jumps over the lazy dog and then it sleeps under a big old tree"
    items = [(10, item), (9, "Short one"), (11, None), (None, "one"), (12, ""), (10, item), (13, "日本語 text"), (14, "a a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [item.upper(), f"before {item} after", " ".join(item.split()[:12]), "short, ONE; short one", "a a a a b a a",
             " ".join(item.split()[3:16]) + " x " + " ".join(item.split()[:13]), None, "", "x" * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for frame in (docs, odd.where("doc_id is null or doc_id <> 5")):
        expected = sorted([(r["doc_id"], *brute_contamination(r["text"], items)) for r in frame.collect()], key=str)
        for block in (4_000_000, 30):  # in one scan and in several
            found = D.contamination(frame, bench, block_chars=block)
            got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()], key=str)
            assert got == expected
    assert D.contamination(none, bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    whole = D.contamination(odd, bench, keep=True)
    assert whole.select("row.*").columns == odd.columns and whole.count() == odd.count()
    hit = D.contamination(odd, bench).where("doc_id = 5").first()
    assert hit["n_hit"] == 0 and hit["n_words"] == 120_000


def test_shift_is_never_too_far():
    words = [bytes([97 + i % 5]) for i in range(300)]
    windows = {tuple(words[i:i + 13]): ["x"] for i in (0, 3)}
    found = sorted(s for s, _ in D.WindowSearch(13, windows).find(words))
    assert found == [i for i in range(288) if tuple(words[i:i + 13]) in windows]
