"""Quality by a byte-level convolutional network, trained and applied in numpy.

Each filter holds a weight for every byte value at each of ``width`` places. Over a
chunk the responses are max-pooled; a linear layer makes a chunk logit, and the
chunks of a document, which overlap and cover all of it, combine by their mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import bounded_sample, plain
from stallwise.session import materialise


def chunks(raw: bytes, size: int, overlap: int) -> np.ndarray:
    """Windows of ``size`` bytes, ``overlap`` shared by neighbours; the last is moved back to end with the text.

    A text shorter than a window is padded with zero bytes.
    """
    if len(raw) <= size:
        return np.frombuffer(raw.ljust(size, b"\0"), np.uint8)[None]
    starts = list(range(0, len(raw) - size, size - overlap)) + [len(raw) - size]
    data = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, size)[starts]


@dataclass
class ByteNet:
    filters: np.ndarray   # width, 256, number of filters
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    chunk: int

    @property
    def overlap(self) -> int:
        return len(self.filters) * 8

    def responses(self, part: np.ndarray) -> np.ndarray:
        width = len(self.filters)
        n = part.shape[1] - width + 1
        out = self.filters[0][part[:, :n]]
        for j in range(1, width):
            out += self.filters[j][part[:, j:j + n]]
        return out

    def pooled(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        out = self.responses(part)
        at = out.argmax(axis=1)
        return np.take_along_axis(out, at[:, None], axis=1)[:, 0] + self.bias, at

    def logit(self, text: str, most: int = 16) -> float:
        found = chunks(text.encode("utf-8", "replace"), self.chunk, self.overlap)
        total = 0.0
        for at in range(0, len(found), most):
            top = self.responses(found[at:at + most]).max(axis=1) + self.bias
            total += float((np.maximum(top, 0) @ self.weight + self.offset).sum())
        return total / len(found)

    def score(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per input row: ``id, score``. Null and empty texts are one chunk of padding."""
        net = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.clip([net.value.logit(body) for body in batch], -30, 30)
                yield pd.Series(1 / (1 + np.exp(-x)), dtype="float64")

        return plain(docs, id, text).select(F.col("id").alias(id), of("body").alias("score"))


EPOCHS = 10


def drawn(found: np.ndarray, epoch: int, epochs: int, least: int) -> np.ndarray:
    """The chunks of a text that an epoch sees: every ``epochs``-th from ``epoch`` on, filled up to ``least`` from those
    that follow. Over all epochs each chunk is seen."""
    turn = (np.arange(len(found)) - epoch) % epochs
    order = np.argsort(turn, kind="stable")
    return found[np.sort(order[:max(int((turn == 0).sum()), least)])]


def train(draw: Callable[[int], list[np.ndarray]], labels: np.ndarray, weights: np.ndarray, width: int = 6,
          filters: int = 16, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteNet:
    """Adam on the weighted log loss; gradients reach a filter through the place where it was largest.

    ``draw(epoch)`` gives the chunks of each text that the epoch sees.
    """
    parts = draw(0)
    rng = np.random.default_rng(seed)
    net = ByteNet(rng.normal(0, 0.3, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32),
                  rng.normal(0, 0.1, filters).astype(np.float32), 0.0, parts[0].shape[1] if parts else 512)
    values = [net.filters, net.bias, net.weight, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for epoch in range(epochs):
        parts = draw(epoch) if epoch else parts
        order = rng.permutation(len(parts))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            sizes = [len(parts[i]) for i in pick]
            part = np.concatenate([parts[i] for i in pick])
            top, where = net.pooled(part)
            active = np.maximum(top, 0)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            logit = np.add.reduceat(active @ net.weight + values[3][0], starts) / sizes
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            slope = ((p - labels[pick]) * weights[pick] / len(pick)).astype(np.float32)
            each = np.repeat(slope / np.array(sizes, np.float32), sizes)
            back = each[:, None] * net.weight * (top > 0)
            grad = np.zeros_like(net.filters)
            rows, cols = np.arange(len(part))[:, None], np.arange(filters)
            for j in range(width):
                np.add.at(grad[j], (part[rows, where + j], cols), back)
            grads = [grad + 1e-5 * net.filters, back.sum(axis=0), active.T @ each + 1e-4 * net.weight,
                     np.array([each.sum()], np.float32)]
            step += 1
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-7)
    net.offset = float(values[3][0])
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
                sample_rows: int = 1500, at_once: int = 4, chunk: int = 512, **options) -> ByteNet:
    """Learns from documents with a label of 0 or 1: at most ``sample_rows`` of each (a documented bound). The net sees
    all chunks of them: an epoch gets one in ``epochs`` of a text's chunks, others each time, and ``at_once`` at
    least. The sample is stored, and the driver holds what one epoch sees. Each class weighs as much as it has rows. Ids that are null are not joined; a label given twice for an id counts once, the larger. With rows of one
    class only, or none, the score is the (smoothed) share of class 1.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("_label")).where(
        "_label in (0, 1)").groupBy("id").agg(F.max("_label").alias("_label"))
    rows = plain(docs, id, text)
    labelled = rows.select("id").join(known, "id")
    share = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    if len(share) < 2:
        p = (share.get(1, 0) + 1) / (total + 2)
        return ByteNet(np.zeros((1, 256, 1), np.float32), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), chunk)
    overlap = options.get("width", 6) * 8

    epochs = options.get("epochs", EPOCHS)
    sample = materialise(bounded_sample(rows, labelled, "_label", sample_rows).select(
        "id", "_label", "body").withColumn("sign", F.xxhash64("body")), "quality-sample")

    def seen(epoch: int):
        @F.pandas_udf("binary")
        def some(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([drawn(chunks(body.encode("utf-8", "replace"), chunk, overlap), epoch, epochs,
                                       at_once).tobytes() for body in batch])

        got = sample.select("id", "_label", "sign", some("body").alias("c")).collect()
        got.sort(key=lambda r: (str(r["id"]), r["sign"]))
        return got

    first = seen(0)
    y = np.array([r["_label"] for r in first])
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weights = np.array([share[c] / total * len(y) / taken[c] for c in y])

    def draw(epoch: int) -> list[np.ndarray]:
        return [np.frombuffer(r["c"], np.uint8).reshape(-1, chunk) for r in (seen(epoch) if epoch else first)]

    return train(draw, y, weights, **options)
