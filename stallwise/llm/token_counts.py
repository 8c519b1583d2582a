"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The count is the number of first symbols less the merges made; no ids are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stallwise.llm.common import plain

SPACE = "▁"


def load_ranks(path: str) -> dict[str, int]:
    """Rank of every piece that may be merged or stand as a character: 0 for the best score.

    Bytes, control and unknown pieces are no text. Equal scores have equal ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    return {piece: order[score] for piece, score in scores.items()}


def count_symbols(text: str, rank: dict[str, int]) -> int:
    """Symbols that stay when the adjacent pair of lowest rank (leftmost of equals) is merged until none is left.

    A character outside the vocabulary counts as its UTF-8 bytes.
    """
    n = len(text)
    if n == 1:
        return 1 if text in rank else len(text.encode("utf-8", "replace"))
    get = rank.get
    stop = list(range(1, n + 1))     # end of the symbol that starts here; 0 when it was merged away
    before = list(range(-1, n))      # start of the symbol to the left
    heap = []
    for i in range(n - 1):
        r = get(text[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapify(heap)
    count = n
    while heap:
        _, left, middle, end = heappop(heap)
        if stop[left] != middle or stop[middle] != end:
            continue
        stop[left], stop[middle] = end, 0
        count -= 1
        if end < n:
            before[end] = left
            further = stop[end]
            r = get(text[left:further])
            if r is not None:
                heappush(heap, (r, left, end, further))
        if left:
            first = before[left]
            r = get(text[first:end])
            if r is not None:
                heappush(heap, (r, first, left, end))
    for i, c in enumerate(text):
        if stop[i] == i + 1 and c not in rank:
            count += len(c.encode("utf-8", "replace")) - 1
    return count


class Chunks(dict):
    """Counts by chunk, worked out when first asked for.

    Two generations of ``limit`` chunks are remembered; what was not asked for since the last change is forgotten.
    """

    def __init__(self, rank: dict[str, int], limit: int):
        super().__init__()
        self.rank, self.limit, self.old = rank, limit, {}

    def __missing__(self, chunk: str) -> int:
        found = self.old.pop(chunk, None)
        if found is None:
            found = count_symbols(chunk, self.rank)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


def chunk_pattern(rank: dict[str, int]) -> re.Pattern:
    """Parts of a text that no merge crosses, as far as the pieces show.

    Spaces stand only in front (a run of spaces stays with what follows), line ends are in no longer piece, letters and
    other characters never meet in a piece. Where the pieces break one of these rules, that cut is left out.
    """
    if any(SPACE in p.lstrip(SPACE) for p in rank):
        return re.compile(r"[\s\S]+")
    line = "" if any("\n" in p for p in rank if len(p) > 1) else "\n"
    parts = [f"[^{SPACE}{line}]+"]
    letters = [p.lstrip(SPACE) for p in rank]
    if not any(re.search(r"[^\W\d_][\W\d_]|[\W\d_][^\W\d_]", p) for p in letters):
        parts = [r"[^\W\d_]+", f"(?:(?![^\\W\\d_])[^{SPACE}{line}])+"]
    any_part = "|".join(parts)
    return re.compile(f"{SPACE}+(?:{any_part}|)|{any_part}" + (f"|{line}" if line else ""))


#: One store of counts for each vocabulary file, kept by a Python worker from task to task.
_REMEMBERED: dict[str, Chunks] = {}


def token_counts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", cache: int = 300_000) -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens`` for the vocabulary file at ``path``.

    A null or empty text has no bytes and no tokens. White space, rare characters and strings of special tokens are
    ordinary text. Repeated rows count each by itself; an empty table gives no rows; further columns are not read.
    The vocabulary goes out by broadcast: its size is the file's, whatever the data. ``cache`` bounds the chunks a
    Python worker remembers.
    """
    rank = load_ranks(path)
    pattern = chunk_pattern(rank)
    sent = docs.sparkSession.sparkContext.broadcast(rank)

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _REMEMBERED:
            _REMEMBERED[path] = Chunks(sent.value, cache)
        of, parts = _REMEMBERED[path].__getitem__, pattern.findall
        for batch in batches:
            yield pd.Series([
                sum(map(of, parts(SPACE + body.replace(" ", SPACE)))) if body else 0 for body in batch], dtype="int64")

    rows = plain(docs, id, text)
    return rows.select(F.col("id").alias(id), F.octet_length("body").cast("long").alias("n_bytes"),
                       tokens("body").alias("n_tokens"))
