"""Byte-level encoding next to the library, whole round trips."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from stallwise.llm import byte_bpe as B
from stallwise.llm.queries import BYTE_RANKS, op11_byte_bpe


@pytest.fixture(scope="module")
def ranks():
    return B.load_ranks(BYTE_RANKS)


def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def texts():
    rng = random.Random(3)
    out = ["", " ", "a", "don't 12 '  \n\n x\t", "<|endoftext|> and <|fim|>", "aaaa" * 500, "ab" * 3000, "x" * 20_001,
           "abcabd" * 700 + "q", "日本語テキスト" * 300, "\U00010ee7a\U000323b0 1\U0001246f", "\x00\x1c\x85  z"]
    out += ["".join(rng.choice("abcdefgh") for _ in range(6000)), "".join(rng.choice("ab") for _ in range(3000))]
    kinds = [(32, 127), (0xa0, 0x2ff), (0x4e00, 0x5000), (0x10000, 0x3ffff)]
    out += ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(1, 200))) for _ in range(200)]
    return out


@pytest.mark.parametrize("long, group, slice_, limit", [(256, 1_000_000, 100_000, 400_000), (8, 50, 3, 20)])
def test_ids_equal_the_library(ranks, monkeypatch, long, group, slice_, limit):
    for name, value in (("LONG", long), ("GROUP", group), ("SLICE", slice_)):
        monkeypatch.setattr(B, name, value)
    bpe, known, given = B.ByteBpe(ranks, P.PATTERN, limit), library(ranks), texts()
    found = list(bpe.encode_all(given))
    assert found == [packed(known.encode_ordinary(t)) for t in given]
    token = {rank: raw for raw, rank in ranks.items()}
    assert [B.unpack(f, token) for f in found] == [t.encode() for t in given]
    assert B.unpack(packed([60_000]), token) is None and B.unpack(b"abc", token) is None


def test_character_classes_equal_the_library_for_every_code_point():
    """A token of 'a', '1', '!' or a space with each byte shows where the pattern cuts."""
    ranks = {bytes([i]): i for i in range(256)}
    for lead in range(256):
        for sign in (b"a", b"1", b"!", b" "):
            ranks[sign + bytes([lead])] = len(ranks)
    given = [f"a{chr(c)} 1{chr(c)} !{chr(c)} {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    known, bpe = library(ranks), B.ByteBpe(ranks, P.PATTERN)
    assert all(a == packed(known.encode_ordinary(t)) for a, t in zip(bpe.encode_all(given), given))


def test_pair_table_holds_all_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 60_000, (50_000, 2)), axis=0).astype(np.int32)
    table = B.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    assert (table.get(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    there = set(map(tuple, keys.tolist()))
    other = [(a, b) for a, b in rng.integers(0, 60_000, (2000, 2)).tolist() if (a, b) not in there]
    a, b = np.array(other, np.int32).T
    assert (table.get(a, b) == B.NONE).all()


def test_odd_rows(spark, odd, none, ranks):
    known = library(ranks)
    found = B.encode(odd, BYTE_RANKS, P.PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    rows = [(r.doc_id, r.n_tokens, bytes(r.ids)) for r in found.collect()]
    want = [(r.doc_id, known.encode_ordinary(r.text or "")) for r in odd.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(rows, key=key) == sorted([(i, len(w), packed(w)) for i, w in want], key=key)
    back = found.select(B.decode(found, BYTE_RANKS).cast("string").alias("t"))
    assert sorted(r.t for r in back.collect()) == sorted(r.text or "" for r in odd.select("text").collect())
    assert B.encode(none, BYTE_RANKS, P.PATTERN).count() == 0
    broken = spark.createDataFrame([(None,), (bytearray(b"abc"),)], "ids binary")
    assert {r[0] for r in broken.select(B.decode(broken, BYTE_RANKS)).collect()} == {None}


def test_query_equals_the_library(spark, folder, ranks):
    known = library(ranks)
    found = {r.doc_id: r for r in op11_byte_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for row in docs:
        ids = known.encode_ordinary(row.text)
        have = found[row.doc_id]
        assert (have.n_tokens, have.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert have.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
