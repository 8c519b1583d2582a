import collections
import hashlib
import random

import numpy as np
import pytest

from stallwise.llm import simhash as S
from stallwise.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from tests_llm_helpers import brute_components, brute_fingerprint


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for i, text in rows:
        ids = [x for x in groups[text or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[text or ""]), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_against_brute_force(spark, odd):
    frame = spark.createDataFrame([(i, f"{'x' * (i % 3)}{i % 7}") for i in range(200)], "doc_id bigint, text string")
    for docs in (odd, frame):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        found = sorted([tuple(r) for r in exact_duplicates(docs, digest_all=True).collect()], key=str)
        assert found == brute_exact(rows)
        part = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(docs, prefix=2).collect()}
        assert part == {x[:4] for x in brute_exact(rows)}


def test_hot_and_cold_groups_against_brute_force(spark):
    """Of 4,000 rows a third is one text and some texts come five times (both hot), others two or three times."""
    rows = [(i, "hot text" if i % 3 == 0 else f"five {i % 400 // 2}" if i % 10 == 1 else f"few {i // 6}" if i % 2 else f"one {i}")
            for i in range(4000)]
    sizes = collections.Counter(collections.Counter(t for _, t in rows).values())
    assert any(n > 4 for n in sizes) and any(2 <= n <= 4 for n in sizes)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted([tuple(r) for r in exact_duplicates(docs, digest_all=True).collect()], key=str) == brute_exact(rows)
    assert sorted([tuple(r)[:4] for r in exact_duplicates(docs, prefix=4).collect()], key=str) == sorted(
        [r[:4] for r in brute_exact(rows)], key=str)
    assert drop_exact_duplicates(docs).count() == len({t for _, t in rows})


def test_full_hash_only_where_length_and_prefix_are_shared(spark):
    docs = spark.createDataFrame([(1, "aaaa1"), (2, "aaaa2"), (3, "bbbb3"), (4, "longer text")], "doc_id bigint, text string")
    hashed = {r["doc_id"]: r["text_sha256"] is not None for r in exact_duplicates(docs, prefix=4).collect()}
    assert hashed == {1: True, 2: True, 3: False, 4: False}


def test_drop_keeps_one_row_of_each_text(odd, none):
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect() if r["doc_id"] is not None) == [
        (2, "alpha bet"), (4, ""), (5, "word0 and"), (6, " \t\n "), (7, "Ünïcödé ﬁ"), (8, "one")]
    assert kept.where("doc_id is null").count() == 1
    assert drop_exact_duplicates(none).count() == 0 and exact_duplicates(none).count() == 0


def test_simhash_against_brute_force(spark, odd, none, folder):
    for docs in (odd, spark.read.parquet(f"{folder}/documents.parquet")):
        found = sorted([(r["doc_id"], r["fp"] & (2 ** 64 - 1), r["component_id"])
                        for r in S.near_duplicates(docs).collect()], key=str)
        rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
        expected = sorted([(i, fp, c) for (i, fp), c in zip(rows, brute_components(rows))], key=str)
        assert found == expected
    assert S.near_duplicates(none).count() == 0
    assert S.near_duplicates(odd).select(S.hexadecimal("fp").alias("h")).where("length(h) <> 16").count() == 0


def test_links_find_all_components_of_planted_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base[:40]:  # chains and a dense cloud
        x = b
        for _ in range(6):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << bit
            fps.add(x)
    dense = base[0]
    fps.update(dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i))
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    signed = [(i, int(np.uint64(fp).astype(np.int64))) for i, fp in rows]
    frame = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    roots = {r["node"]: r["root"] for r in S.components(S.links(frame.select("fp"), 3)).collect()}
    groups = collections.defaultdict(set)
    for (i, fp), (_, s) in zip(rows, signed):
        groups[roots.get(s, s)].add(i)
    expected = collections.defaultdict(set)
    for (i, _), c in zip(rows, brute_components(rows)):
        expected[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_every_point_is_near_a_code_word():
    points = np.random.default_rng(1).integers(0, 2 ** 31, 500).astype(np.uint64)
    rows, words = S.anchors(points, 1)
    assert set(rows) == set(range(500)) and not S._syndrome(words).any()
    assert (np.bitwise_count(points[rows] ^ words) <= 1).all()
    rows, words = S.anchors(points, 2)
    assert (np.bitwise_count(points[rows] ^ words) <= 2).all()
    assert np.bincount(rows, minlength=500)[S._syndrome(points) != 0].min() == 16


def test_distance_is_checked(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp bigint"), 4)
