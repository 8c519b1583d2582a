import random

import pytest

from stallwise.llm import cube as C


def test_targets_share_by_weight_and_stop_at_the_limit():
    found = C.targets({"b": 100, "a": 1000, None: 500, "c": 10})
    assert list(sorted(k for k in found if k)) == ["a", "b", "c"]
    assert sum(found.values()) == pytest.approx(1.5 * 1610)
    assert found["b"] == 200 and found["c"] == 20
    assert found[None] == 1000 and found["a"] == pytest.approx(1195)  # the fourth weighs 3 again and stops at its limit
    assert C.targets({}) == {} and C.targets({"a": 0, None: 0}) == {"a": 0, None: 0}


def test_flight_keeps_both_balances_and_leaves_two():
    rng = random.Random(3)
    size = sorted([rng.randint(1, 900) for _ in range(500)], reverse=True)
    count, p = [1] * 500, [0.37] * 500
    left = C.flight(p, size, count, rng.random)
    assert len(left) <= 2 and all(x in (0, 1) for k, x in enumerate(p) if k not in left)
    assert sum(x * s for x, s in zip(p, size)) == pytest.approx(0.37 * sum(size))
    assert sum(p) == pytest.approx(0.37 * 500)


def test_inclusion_probabilities_hold_on_average():
    size, hits = [5, 9, 2, 7, 4, 4, 8, 1, 3, 6], [0] * 10
    for seed in range(3000):
        p = [0.3] * 10
        draw = random.Random(seed).random
        left = C.flight(p, size, [1] * 10, draw)
        for k in left:
            p[k] = float(draw() < p[k])
        hits = [h + x for h, x in zip(hits, p)]
    assert all(abs(h / 3000 - 0.3) < 0.04 for h in hits)


def test_mix_meets_targets_in_several_levels(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = C.mix(docs, block=64).collect()
    again = {tuple(r) for r in C.mix(docs.repartition(5, "text"), block=64).collect()}
    assert len(found) == 3000 and {tuple(r) for r in found} == again
    sizes, taken = {}, {}
    source = {i: s for i, _, s in rows}
    words = {i: len(t.split()) for i, t, _ in rows}
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        sizes[s], taken[s] = r["source_size"], taken.get(s, 0) + r["taken"]
    goal = C.targets(sizes)
    assert sizes == {s: sum(n for i, n in words.items() if source[i] == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= 60 for s in goal)


def test_odd_rows(odd, none):
    rows = C.mix(odd).collect()
    assert len(rows) == odd.count() and C.mix(none).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["size"], r["taken"]))
    assert all(len(v) == 1 for v in by.values())  # repeated rows alike
    assert by[4] == {(0, 0)} and by[6] == {(0, 0)}


def test_sources_of_rows_alike_come_near_their_targets(spark):
    seven = "a b c d e f g"
    rows = [(None, seven, "null ids")] * 1000 + [(1, f"{seven[:-1]}{i}", "one id") for i in range(5001)]
    rows += [(2 ** 60 + i, seven, "long ids") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = C.mix(docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _, _ in rows)
    again = sorted(str(tuple(r)) for r in C.mix(docs.repartition(7)).collect())
    assert sorted(str(tuple(r)) for r in found) == again
    taken = {}
    for r in found:
        taken[r["target"]] = taken.get(r["target"], 0) + r["taken"]
        assert r["taken"] in (0, 7, 14)
    goal = C.targets({"null ids": 7000, "one id": 35007, "long ids": 2100})
    assert len(taken) == 3 and all(abs(taken[t] - t) <= 7 for t in goal.values())
