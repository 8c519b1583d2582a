"""Occurrences of benchmark passages by Wu-Manber search over words.

The patterns are windows of consecutive item words. A shift table over blocks of
two words tells how far the search may jump; where the shift is zero, the bucket
of the block that ends the pattern names the windows to compare word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stallwise.llm.common import LOWER, UPPER, plain
from stallwise.session import materialise

#: ASCII letters fold to lower case, digits stay, other ASCII parts words; bytes of 0x80 and above are word bytes.
_FOLDED = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def benchmark_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_FOLDED).split()


class WindowSearch:
    """Shift tables and suffix buckets of all windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[list[bytes], list[str]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.bucket.setdefault(window[length - self.block:], []).append((list(window), items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start of each occurrence with the items that have the window."""
        length, default, shift, bucket, n = self.length, self.default, self.shift, self.bucket, len(words)
        at = length - 1
        pairs = self.block == 2
        while at < n:
            key = (words[at - 1], words[at]) if pairs else (words[at],)
            jump = shift.get(key, default)
            if jump:
                at += jump
                continue
            start = at - length + 1
            for window, items in bucket.get(key, ()):
                if words[start:at + 1] == window:
                    yield start, items
            at += 1


def searches(items: Iterable[tuple[str, str | None]], length: int) -> list[WindowSearch]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = benchmark_words(text)
        size = min(length, len(words))
        for start in range(len(words) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(tuple(words[start:start + size]), [])
            if item not in owners:
                owners.append(item)
    return [WindowSearch(size, windows) for size, windows in sorted(by_length.items())]


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def _blocks(benchmark: DataFrame, id: str, text: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of at most ``block_chars`` characters (or one item), read one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id).cast("string"), F.col(text).cast("string")).where(
        F.col(id).isNotNull() & F.col(text).isNotNull())
    for item, body in rows.toLocalIterator():
        if block and size + len(body) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += len(body)
    if block:
        yield block


_FOUND = "array<array<bigint>>"


def _scan(frame: DataFrame, found: list[WindowSearch]) -> DataFrame:
    tables = frame.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType([*[f for f in frame.schema.fields if f.name not in ("n_words", "spans", "items")],
                           *T._parse_datatype_string(f"n_words bigint, spans {_FOUND}, items array<string>").fields])
    arrow = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, owners = [], [], []
            have = batch.schema.names
            before = [batch.column("spans").to_pylist(), batch.column("items").to_pylist()] if "spans" in have else None
            for i, value in enumerate(batch.column("body")):
                words = benchmark_words(value.as_py())
                here, items = (before[0][i], set(before[1][i])) if before else ([], set())
                for search in tables.value:
                    for start, of in search.find(words):
                        here.append([start, start + search.length])
                        items.update(of)
                counts.append(len(words))
                spans.append(merged(here))
                owners.append(sorted(items))
            kept = [n for n in have if n not in ("n_words", "spans", "items")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(counts, pa.int64()), pa.array(spans, arrow[0]),
                 pa.array(owners, arrow[1])], names=[*kept, "n_words", "spans", "items"])

    return frame.mapInArrow(scan, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", length: int = 13,
                  block_chars: int = 4_000_000, keep: bool = False) -> DataFrame:
    """One row per document: ``id, n_words, spans, items, n_hit``, and with ``keep`` the whole input row as ``row``.

    ``spans`` are the hit word ranges [start, stop), disjoint and in order; ``items`` the ids (as text, sorted) of
    items with an occurring window. An item shorter than ``length`` words is one window; an item or document with
    null or no words has none. Repeated items count once, items with a null id or text not at all. Empty tables give no
    hits or no rows. The documents are scanned once, without a shuffle, for each ``block_chars`` characters of
    benchmark text: that bounds what is sent to executors, and a larger benchmark takes several scans.
    """
    found = plain(docs, id, text, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []))
    done = False
    for block in _blocks(benchmark, item_id, item_text, block_chars):
        found = _scan(materialise(found, "benchmark-scan") if done else found, searches(block, length))
        done = True
    if not done:
        found = _scan(found, [])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select(F.col("id").alias(id), "n_words", "spans", "items", n_hit.alias("n_hit"),
                        *(["row"] if keep else []))


def contaminated():
    """The rule of the contract: a hit, and at least one word in twenty hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
