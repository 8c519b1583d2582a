"""Language by the nearest of several centroids per language, in hashed n-gram TF-IDF space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import bounded_sample, plain

#: ASCII bytes other than letters part words.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20


@dataclass(frozen=True)
class Space:
    """Byte n-grams of one to three, hashed to 2**bits places."""

    bits: int = 12

    @property
    def tables(self) -> np.ndarray:
        return np.random.default_rng(7).integers(0, 1 << self.bits, (3, 256), dtype=np.int64)

    def counts(self, text: str, tables: np.ndarray) -> np.ndarray:
        raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())
        data = np.frombuffer(b" " + raw + b" ", np.uint8)
        out = np.zeros(1 << self.bits, np.int64)
        for at in range(0, len(data), _PIECE):
            part = data[at:at + _PIECE + 2]
            one, two, three = (t[part] for t in tables)
            for found in (one[:-2], one[:-1] ^ two[1:], one[:-2] ^ two[1:-1] ^ three[2:]):
                out += np.bincount(found, minlength=1 << self.bits)
        return out


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    found = (np.log1p(counts) * idf).astype(np.float32)
    size = float(np.linalg.norm(found))
    return found / size if size else found


def _clusters(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from spread-out starts; no random choice."""
    starts = [points.mean(axis=0)]
    for _ in range(min(k, len(points)) - 1):
        starts.append(points[np.argmin(np.max(points @ np.array(starts).T, axis=1))])
    centres = np.array(starts)
    for _ in range(rounds):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        near = np.argmax(points @ centres.T, axis=1)
        centres = np.array([points[near == c].mean(axis=0) if (near == c).any() else centres[c]
                            for c in range(len(centres))])
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    space: Space
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]      # language of each centroid
    least: np.ndarray     # cosine below which a text is too far from the centroid

    def predict(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per input row: ``id, language, score, rejected``.

        ``language`` is the nearest centroid's; null when the text is null or has no letter or the model knows no
        language. ``score`` is the cosine, 0 to 1. ``rejected`` marks texts farther from that centroid than its
        members are.
        """
        model = docs.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("language string, score double, rejected boolean")
        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            m = model.value
            tables = m.space.tables
            for batch in batches:
                found = []
                for body in batch:
                    near = m.centroids @ _vector(m.space.counts(body, tables), m.idf)
                    best = int(np.argmax(near))
                    found.append((m.names[best], float(min(max(near[best], 0.0), 1.0)), bool(near[best] < m.least[best])))
                yield pd.DataFrame(found, columns=["language", "score", "rejected"])

        rows = plain(docs, id, text)
        letters = F.col("body").rlike(r"\p{L}")
        none = F.lit(None).cast("struct<language:string,score:double,rejected:boolean>")
        if not self.names:
            rows = rows.withColumn("r", none)
        else:
            rows = rows.withColumn("r", nearest("body")).withColumn("r", F.when(letters, F.col("r")))
        return rows.select(F.col("id").alias(id), "r.language", F.coalesce("r.score", F.lit(0.0)).alias("score"),
                           F.coalesce("r.rejected", F.lit(True)).alias("rejected"))


def fit_language(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = 12,
                 clusters: int = 4, sample_rows: int = 400, rounds: int = 8, slack: float = 0.02) -> LanguageModel:
    """Learns from rows with a language and a letter; without any, the model knows no language.

    Document frequencies cover all those rows. The centroids are fitted on at most ``sample_rows`` rows a language,
    chosen by a hash of the id; that many vectors of 2**bits numbers reach the driver. A centroid rejects texts whose
    cosine is below the lowest hundredth of its sample members less ``slack``.
    """
    space = Space(bits)
    rows = plain(docs, id, text, F.col(lang).cast("string").alias("_lang")).where(
        F.col("_lang").isNotNull() & F.col("body").rlike(r"\p{L}"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, total, n = space.tables, np.zeros(1 << space.bits, np.int64), 0
        for batch in batches:
            for body in batch.column(0):
                total += space.counts(body.as_py(), tables) > 0
                n += 1
        place = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(total[total > 0], n))],
                                         names=["place", "n"])

    # one row for each place of the space and one for the number of rows
    frequency = {r["place"]: r["n"] for r in rows.select("body").mapInArrow(
        seen, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    n = frequency.pop(-1, 0)
    df = np.zeros(1 << bits)
    df[list(frequency)] = list(frequency.values())
    idf = np.log((1 + n) / (1 + df)) + 1

    @F.pandas_udf("binary")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = space.tables
        for batch in batches:
            yield pd.Series([_vector(space.counts(body, tables), idf).tobytes() for body in batch])

    picked = bounded_sample(rows.drop("_lang"), rows.select("id", "_lang"), "_lang", sample_rows).select("_lang", "id", vectors("body").alias("v")).collect()
    by: dict[str, list] = {}
    for row in sorted(picked, key=lambda r: (r["_lang"], str(r["id"]), r["v"])):
        by.setdefault(row["_lang"], []).append(np.frombuffer(row["v"], np.float32))
    centroids, names, least = [], [], []
    for name, found in by.items():
        points = np.array(found)
        centres = _clusters(points, clusters, rounds)
        cosine = points @ centres.T
        near = np.argmax(cosine, axis=1)
        for c, centre in enumerate(centres):
            own = cosine[near == c, c]
            centroids.append(centre)
            names.append(name)
            least.append(float(np.quantile(own, 0.01)) - slack if len(own) else 1.0)
    return LanguageModel(space, idf, np.array(centroids, np.float32).reshape(len(names), 1 << bits), names,
                         np.array(least))
