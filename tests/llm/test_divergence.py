"""Divergence of sources next to a count of every term in every group."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stallwise.llm import divergence as D


def plainly(rows, least=3):
    """All figures of (text, lang, source) rows, term by term in whole numbers."""
    langs, docs, n = defaultdict(set), Counter(), Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        docs.update((lang, t) for t in set(terms))
        n.update((lang, source, t) for t in terms)
    pairs, tops = set(), set()
    for lang, sources in langs.items():
        kept = [t for (l, t), k in docs.items() if l == lang and k >= least]
        share = {}
        for s in [*sources, None]:
            count = {t: n[lang, s, t] if s is not None else sum(n[lang, o, t] for o in sources) for t in kept}
            total = sum(count.values())
            share[s] = {t: 1 + 10 ** 9 * (c + 1) // (total + len(kept)) for t, c in count.items()}
        f = lambda p, q: (p - q) * (p - q) // q
        for a in sources:
            pairs |= {(lang, a, b, sum(f(share[a][t], share[b][t]) for t in kept)) for b in sources if b != a}
            tops |= {(lang, a, t, f(share[a][t], share[None][t])) for t in kept
                     if n[lang, a, t] and share[a][t] > share[None][t]}
    return pairs, tops


def made_rows(n=400, sources=9):
    rng = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Ünï", "ÜNÏ", "日本", "x1y", "Zz"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, ""])
        own = rng.randrange(sources)
        some = [words[min(int(rng.paretovariate(0.7)) + own % 3, len(words) - 1)] for _ in range(rng.randrange(0, 40))]
        rows.append((" ".join(some) if some else rng.choice([None, "", "12 .. 3"]), lang, rng.choice([f"s{own}", "s0"])))
    rows += [("only here once", "xx", "a"), (None, "xx", "b"), (None, None, None), ("word " * 30_000, "de", "s1")]
    return rows


@pytest.mark.parametrize("block", [48, 2])
def test_equals_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    rows = made_rows()
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    found = D.Divergence(frame)
    pairs, tops = plainly(rows)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    assert {tuple(r) for r in found.terms().collect()} == tops
    ranks = D.ranked(found.terms(), "term", 5).collect()
    best = sorted((-v, t) for l, s, t, v in tops if (l, s) == ("en", "s1"))[:5]
    assert [(-r.value, r.item) for r in sorted((r for r in ranks if (r.lang, r.source) == ("en", "s1")),
                                               key=lambda r: r["rank"])] == best


def test_runs_are_fewer_than_counts(spark):
    found = D.Divergence(spark.createDataFrame(made_rows(1500), "text string, lang string, source string"))
    assert found.runs().where("source IS NOT NULL").count() < found.cells.count()


@pytest.mark.parametrize("cells, batch", [(100_000, 7), (10, 3), (4, 50), (1, 2)])
def test_runs_give_every_count_back(monkeypatch, cells, batch):
    monkeypatch.setattr(D, "CELLS", cells)
    rng = random.Random(cells)
    rows = [(lang, f"t{i:03}", f"s{s}", rng.choice([1, 1, 2])) for lang in ("a", "b") for i in range(40)
            for s in range(8) if rng.random() < 0.6 or i % 9 == 0]
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([3] * len(part)), *(pa.array([r[k] for r in part]) for k in range(4))],
        names=["part", "lang", "term", "source", "n"]) for part in (rows[i:i + batch] for i in range(0, len(rows), batch))]
    runs = [r for b in D._encoded(iter(batches)) for r in b.to_pylist()]
    sizes = {(r["lang"], r["chunk"]): r["length"] for r in runs if r["source"] is None}
    assert all(r["start"] + r["length"] <= sizes[r["lang"], r["chunk"]] for r in runs if r["source"] is not None)
    terms = {lang: sorted({t for l, t, _, _ in rows if l == lang}) for lang in ("a", "b")}
    back, base = set(), {"a": 0, "b": 0}
    for lang, chunk in sorted(sizes):
        for r in runs:
            if (r["lang"], r["chunk"]) == (lang, chunk) and r["source"] is not None:
                back |= {(lang, terms[lang][base[lang] + r["start"] + k], r["source"], r["n"]) for k in range(r["length"])}
        base[lang] += sizes[lang, chunk]
    assert back == set(rows) and base == {lang: len(t) for lang, t in terms.items()}


def test_compare_in_groups_and_exact_shares(monkeypatch):
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 5, 10 ** 12, 3 * 10 ** 14])
    assert D.share(n, 4 * 10 ** 14, 7).tolist() == [1 + 10 ** 9 * (int(c) + 1) // (4 * 10 ** 14 + 7) for c in n]

    def column(size):
        cuts = np.unique(np.concatenate([[0, 500], rng.integers(1, 500, size)]))
        return cuts, rng.integers(1, 10 ** 8, len(cuts) - 1)

    a, others = ("a", *column(30)), [("b", *column(k)) for k in (1, 4, 90)]
    wide = lambda c: np.repeat(c[2], np.diff(c[1]))
    want = [int(sum((p - q) ** 2 // q for p, q in zip(wide(a).tolist(), wide(b).tolist()))) for b in others]
    assert D.compare(a, others) == want


def test_terms_of_a_long_text_are_whole(monkeypatch):
    monkeypatch.setattr(D, "PART", 10)
    text = "Alpha beta-gamma1delta ÜÖ é " * 50
    assert [t for part in D.terms_of(text) for t in part] == [
        t.encode() for t in "alpha beta gamma delta ÜÖ é".split()] * 50
    assert list(D.terms_of(None)) == []


def test_empty_and_odd(spark, none, odd):
    found = D.Divergence(none)
    assert found.pairs().count() == 0 and found.terms().count() == 0
    rows = [(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()]
    pairs, tops = plainly(rows)
    found = D.Divergence(odd)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    assert {tuple(r) for r in found.terms().collect()} == tops
