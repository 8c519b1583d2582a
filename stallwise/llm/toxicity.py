"""Toxicity by weak supervision.

Many voters, each a lexicon or a pattern, say toxic, clean or nothing about a text. A
generative label model estimates how accurate they are and which of them depend on
each other, and gives each text a posterior; a linear classifier over the terms is
trained on those posteriors and scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import bounded_sample, plain, whole_text, words_of
from stallwise.session import materialise

_BETWEEN = re.compile(r"[\W\d_]+")
#: Voters that need no lexicon: an insult's address, shouting, piled-up marks.
_ADDRESS = re.compile(r" (?:you are|you re|you|such) (?:a|an|so|all|just) ")


def normal(text: str) -> str:
    """Letters in lower case, everything else one space, a space at both ends."""
    return f" {_BETWEEN.sub(' ', text.lower()).strip()} "


def terms_of(body: str) -> set[str]:
    """Whole words, word beginnings of four to seven letters and letter runs of five, spaces marking word ends."""
    found = set()
    for word in set(body.split()):
        found.add(f" {word} ")
        found.update([f" {word[:n]}" for n in (4, 5, 6, 7)])
        found.update([word[i:i + 5] for i in range(len(word) - 4)])
    return found


def signature(text: str) -> int:
    """Least hash of the three-word shingles: near copies mostly share it."""
    words = words_of(text)
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 1) >> 1
    return min(xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 1) for i in range(len(words) - 2)) >> 1


def automaton(terms: list[str]):
    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(term, i)
    if terms:
        out.make_automaton()
    return out


def hits(machine, body: str) -> list[int]:
    return sorted({i for _, i in machine.iter(body)}) if len(machine) else []


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 30) -> np.ndarray:
    """Posterior of class 1 from votes (rows x voters; 1 toxic, 0 clean, -1 none).

    Expectation and maximisation over each voter's chances of voting each way given the class. What voters share
    beyond the class is estimated from their residuals, and a voter counts the less the more others repeat it.
    """
    shown = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    said = (votes == 1).sum(axis=1) - 0.5 * (votes == 0).sum(axis=1)
    post = np.where(said > 0, 0.9, np.where(said < 0, 0.02, prior))
    share = np.ones(votes.shape[1])
    for round_ in range(rounds):
        chances = []
        for p in (1 - post, post):
            w = p * weight
            table = np.einsum("n,nvk->vk", w, shown) + 0.5
            chances.append(table / table.sum(axis=1, keepdims=True))
        if round_ == rounds // 2:
            residual = (votes == 1) - np.where(post[:, None] > 0.5, chances[1][:, 2], chances[0][:, 2])
            residual = residual * np.sqrt(weight)[:, None]
            size = np.sqrt((residual ** 2).sum(axis=0)) + 1e-9
            depends = np.clip(residual.T @ residual / np.outer(size, size), 0, 1)
            np.fill_diagonal(depends, 0)
            share = 1 / (1 + depends.sum(axis=1))
        logit = np.log(prior / (1 - prior)) + np.einsum("nvk,vk->n", shown, share[:, None] * (
            np.log(chances[1]) - np.log(chances[0])))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


class Found:
    """Which terms stand in which rows: a sparse table of ones, so its size is that of what was found."""

    def __init__(self, rows: list[list[int]], n_terms: int):
        self.n_rows, self.n_terms = len(rows), n_terms
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.term = np.array([t for r in rows for t in r], int)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.term], self.n_rows)

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.term, r[self.row], self.n_terms)

    def any(self, terms: list[int]) -> np.ndarray:
        chosen = np.zeros(self.n_terms)
        chosen[terms] = 1
        return self.times(chosen) > 0


def linear(found: Found, target: np.ndarray, weight: np.ndarray, ridge: float = 0.05,
           steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic weights for soft labels, by damped Newton steps; ``ridge`` holds the weights, not the offset.

    Each step is solved by conjugate gradients, which need the sparse table only.
    """
    hold = np.append(np.full(found.n_terms, ridge), 1e-6)
    w = np.zeros(found.n_terms + 1)

    def times(v: np.ndarray) -> np.ndarray:
        return found.times(v[:-1]) + v[-1]

    def turned(r: np.ndarray) -> np.ndarray:
        return np.append(found.turned(r), r.sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope = turned((p - target) * weight) + hold * w
        bend = p * (1 - p) * weight + 1e-6
        scale = 1 / (np.append(found.turned(bend), bend.sum()) + hold)
        step, rest = np.zeros_like(w), slope.copy()
        way = scale * rest
        gain = rest @ way
        for _ in range(500):
            if gain < 1e-16:
                break
            along = turned(bend * times(way)) + hold * way
            size = gain / (way @ along)
            step, rest = step + size * way, rest - size * along
            gain, before = rest @ (scale * rest), gain
            way = scale * rest + gain / before * way
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    terms: list[str]
    weights: np.ndarray
    offset: float

    def scorer(self, docs: DataFrame):
        """The score of a text column as a column function; no row is moved."""
        model = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = model.value
            machine = automaton(m.terms)
            for batch in batches:
                x = np.array([m.offset + m.weights[hits(machine, normal(body))].sum() for body in batch], dtype=float)
                yield pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))), dtype="float64")

        return of

    def score(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per input row: ``id, score``; null and empty texts have no term and get the base score."""
        return plain(docs, id, text).select(F.col("id").alias(id), self.scorer(docs)("body").alias("score"))

    def keep(self, docs: DataFrame, cut: float, text: str = "text") -> DataFrame:
        """``docs`` without the rows whose score reaches ``cut``; all columns as they were."""
        return docs.where(self.scorer(docs)(whole_text(text)) < cut)


def voters(terms: list[str], groups: int) -> list[list[int]]:
    """Lexicons (whole words) and patterns (parts of words), each dealt to several voters by rank."""
    words = [i for i, t in enumerate(terms) if t.startswith(" ") and t.endswith(" ")]
    parts = [i for i, t in enumerate(terms) if not (t.startswith(" ") and t.endswith(" "))]
    return [g for kind in (words, parts) for g in (kind[k::groups] for k in range(groups)) if g]


def vote(found: Found, marks: np.ndarray, lexicons: list[list[int]]) -> np.ndarray:
    """Rows x voters. A lexicon says toxic or nothing; its absence voters, each over half of all terms, clean or
    nothing; a pattern toxic or nothing."""
    columns = [np.where(found.any(g), 1, -1) for g in lexicons]
    columns += [np.where(found.any(list(range(half, found.n_terms, 2))), -1, 0) for half in (0, 1)]
    columns += [np.where(m, 1, -1) for m in marks.T]
    return np.stack(columns, axis=1)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
                 sample_rows: int = 4000, least: int = 4, groups: int = 8) -> ToxicityModel:
    """Learns from documents with a label of 0 or 1, at most ``sample_rows`` of each (a documented bound).

    Near copies within the sample count once, the one with the least id. Lexicons are all terms that mark toxic rows (in
    at least ``least`` of them, and fifteen times as often as in clean rows). Null ids are not joined, an id labelled
    twice counts as toxic if one label says so. Without rows of both classes the score is the share of class 1.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("_label")).where(
        "_label in (0, 1)").groupBy("id").agg(F.max("_label").alias("_label"))
    rows = plain(docs, id, text)
    labelled = rows.select("id").join(known, "id")
    share = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        p = (share.get(1, 0) + 1) / (total + 2)
        return ToxicityModel([], np.zeros(0), float(np.log(p / (1 - p))))

    signed = F.pandas_udf(lambda bodies: pd.Series([signature(b) for b in bodies], dtype="int64"), "bigint")
    picked = bounded_sample(rows, labelled, "_label", sample_rows).select("id", "_label", "body", signed("body").alias("sign"))
    first = picked.groupBy("_label", "sign").agg(F.min(F.struct("id", "body")).alias("row"))
    sample = materialise(first.select("_label", "sign", "row.*"), "toxicity-sample")
    taken = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for y, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[y].update(terms_of(normal(body.as_py())))
        terms = list(counts[1])  # a term of no toxic row is no candidate
        clean = [t for t in counts[0] if t not in counts[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms + clean, pa.string()), pa.array([counts[1][t] for t in terms] + [0] * len(clean), pa.int64()),
             pa.array([counts[0][t] for t in terms + clean], pa.int64())], names=["term", "toxic", "clean"])

    rate = lambda c, y: (F.col(c) + 0.5) / (taken[y] + 1.0)
    ratio = rate("toxic", 1) / rate("clean", 0)
    seen = sample.select("_label", "body").mapInArrow(tally, "term string, toxic bigint, clean bigint")
    top = seen.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(
        (F.col("toxic") >= least) & (ratio >= 15)).orderBy(
        (F.col("toxic") * F.log(ratio)).desc(), "term")
    terms = [r["term"] for r in top.select("term").collect()]
    lexicons = voters(terms, groups)

    @F.pandas_udf("found array<int>, address boolean, shouting boolean, piled boolean")
    def seen_in(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = automaton(terms)
        for batch in batches:
            out = []
            for body in batch:
                plain_text = normal(body)
                letters = sum(map(str.isalpha, body))
                out.append((hits(machine, plain_text), bool(_ADDRESS.search(plain_text)),
                            2 * sum(map(str.isupper, body)) > max(letters, 1), body.count("!!") > 3))
            yield pd.DataFrame(out, columns=["found", "address", "shouting", "piled"])

    got = sample.select("id", "_label", "sign", seen_in("body").alias("s")).select("id", "_label", "sign", "s.*").collect()
    got.sort(key=lambda r: (r["_label"], r["sign"], str(r["id"])))
    found = Found([list(r["found"]) for r in got], len(terms))
    marks = np.array([[r["address"], r["shouting"], r["piled"]] for r in got])
    weight = np.array([share[r["_label"]] / taken[r["_label"]] for r in got], float)
    weight *= len(got) / weight.sum()
    post = label_model(vote(found, marks, lexicons), weight, share[1] / total)
    weights, offset = linear(found, post, weight)
    return ToxicityModel(terms, weights, offset)
