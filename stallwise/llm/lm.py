"""Document likelihood over the subword lattice of an existing vocabulary.

A word is a space mark and its characters. Every way to cut it into pieces of the
vocabulary is a path; the weights of all paths add up, by a forward recursion over
log weights. The piece scores of the file start the weights, expected counts over the
corpus fit them, for each component (language) by itself. A word of the corpus also
has an edge of its own, with its discounted count. A document's probability is the
sum over the components.

Texts are encoded once by block, a run of rows of bounded size with its own list of
words, so word statistics are joined to one row per word and block, not per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallwise.llm.common import plain, words_of
from stallwise.session import materialise, scratch_path

SPACE = "▁"
#: Words whose lattices are worked on together.
WORDS = 20_000


def load_pieces(path: str) -> tuple[dict[str, int], np.ndarray]:
    """Number of each piece and its weight by its score: one over its rank. The last 256 are the single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    kept.sort(key=lambda i: -model.get_score(i))
    pieces = {model.id_to_piece(i): n for n, i in enumerate(kept)}
    return pieces, 1.0 / (np.arange(len(pieces) + 256) + 10.0)


class Trie:
    """Pieces of at most ``longest`` characters by character, as sorted (node, character) keys."""

    def __init__(self, pieces: dict[str, int], longest: int):
        children: dict[int, int] = {}
        numbers = [-1]
        for piece, number in pieces.items():
            if 0 < len(piece) <= longest:
                node = 0
                for char in piece:
                    key = node << 21 | ord(char)
                    if key not in children:
                        children[key] = len(numbers)
                        numbers.append(-1)
                    node = children[key]
                numbers[node] = number
        self.longest, self.numbers = longest, np.array(numbers)
        self.keys = np.array(sorted(children), np.int64)
        self.children = np.array([children[key] for key in self.keys.tolist()], np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have a child by their character, these children)."""
        keys = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, np.int64)
        return there, self.children[at[there]]


class Lattice:
    """All edges of many words' lattices: node ``source`` to node ``target`` by ``piece``."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int, trie: Trie | None = None):
        trie, n_pieces = trie or Trie(pieces, longest), len(pieces)
        text = "".join([SPACE + word for word in words])
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(word) + 1 for word in words], np.int64)
        ends = np.cumsum(sizes)
        word_of = np.repeat(np.arange(len(words)), sizes)
        node, end = np.arange(len(chars)) + word_of, ends[word_of]     # a word has a node more than characters
        position = np.arange(len(chars)) - (ends - sizes)[word_of]
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        spelled = np.ones(len(chars), bool)     # a character outside the vocabulary is spelled in bytes
        source, piece, length = [], [], []
        for size in range(1, trie.longest + 1):
            inside = np.flatnonzero(at + size <= end[at])
            at, state = at[inside], state[inside]
            there, state = trie.step(state, chars[at + size - 1])
            at = at[there]
            number = trie.numbers[state]
            whole = np.flatnonzero(number >= 0)
            if size == 1:
                spelled[at[whole]] = False
            source.append(at[whole])
            piece.append(number[whole])
            length.append(np.full(len(whole), size))
        by_bytes = np.flatnonzero(spelled)
        raw = [text[i].encode("utf-8", "replace") for i in by_bytes.tolist()]
        before = sum(map(len, source))  # log weight factors of byte paths are sums of several pieces
        extra = [(before + n, [n_pieces + b for b in own[1:]]) for n, own in enumerate(raw)]
        source = np.concatenate([*source, by_bytes])
        piece = np.concatenate([*piece, np.array([n_pieces + own[0] for own in raw], np.int64)])
        length = np.concatenate([*length, np.ones(len(raw), np.int64)])
        self.nodes = len(chars) + len(words)
        self.last = ends + np.arange(len(words))
        self.first = self.last - sizes
        position, source = position[source] + length, node[source]
        target = source + length
        # by place in the word, then by target, then by source
        order = np.argsort((position * (self.nodes + 1) + target) * (trie.longest + 2) - length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.source, self.target, self.piece = source[order], target[order], piece[order]
        steps = position[order]
        self.steps = np.split(np.arange(len(order)), np.flatnonzero(np.diff(steps)) + 1) if len(order) else []
        self.bytes_at = place[np.array([e for e, rest in extra for _ in rest], np.int64)]
        self.bytes_of = np.array([b for _, rest in extra for b in rest], np.int64)

    def weights(self, log_p: np.ndarray) -> np.ndarray:
        out = log_p[self.piece]
        np.add.at(out, self.bytes_at, log_p[self.bytes_of])
        return out

    @staticmethod
    def _sum(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of the sums over runs of equal keys."""
        starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
        top = np.maximum.reduceat(values, starts, axis=0)
        run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(keys)]))))
        return keys[starts], top + np.log(np.add.reduceat(np.exp(values - top[run]), starts, axis=0))

    def forward(self, edges: np.ndarray) -> np.ndarray:
        alpha = np.full((self.nodes, edges.shape[1]), -np.inf)
        alpha[self.first] = 0
        for step in self.steps:
            nodes, value = self._sum(alpha[self.source[step]] + edges[step], self.target[step])
            alpha[nodes] = value
        return alpha

    def expected(self, edges: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece (and byte) when word w occurs ``counts[w]`` times."""
        alpha = self.forward(edges)
        back = np.zeros((self.nodes, edges.shape[1]))  # share of the word's weight that passes a node
        back[self.last] = counts
        used = np.zeros_like(edges)
        for step in reversed(self.steps):
            pass_ = np.exp(alpha[self.source[step]] + edges[step] - alpha[self.target[step]]) * back[self.target[step]]
            used[step] = pass_
            np.add.at(back, self.source[step], pass_)
        out = np.zeros((size, edges.shape[1]))
        for k in range(edges.shape[1]):
            out[:, k] = np.bincount(self.piece, used[:, k], size) + np.bincount(
                self.bytes_of, used[self.bytes_at, k], size)
        return out


def _normal(uses: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log weights: beginnings share one, the others share one with the end of the word."""
    uses = uses + 1e-3
    begin, inside = uses * starts[:, None], uses * ~starts[:, None]
    return np.log(np.where(starts[:, None], begin / begin.sum(axis=0), inside / (inside.sum(axis=0) + words + 1)))


def _packed(codes: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Word numbers of a text in rising order, as compressed differences: sums over them need no order."""
    codes = np.sort(codes)
    return press.compress(np.diff(codes, prepend=codes.dtype.type(0)).tobytes()) if len(codes) else b""


def _unpacked(raw: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.cumsum(np.frombuffer(press.decompress(raw), np.int32)) if raw else np.zeros(0, np.int64)


def _encode(rows: DataFrame, names: list[str], block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Two stored tables by block: documents as word numbers, and words with their learned counts."""
    k = len(names)
    id_type = rows.schema["id"]
    fields = [T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), id_type,
              T.StructField("held", T.BooleanType()), T.StructField("codes", T.BinaryType()),
              T.StructField("word", T.BinaryType()), T.StructField("at", T.IntegerType()),
              *[T.StructField(f"c{i}", T.LongType()) for i in range(k)]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId()) << 24
        table: dict[bytes, int] = {}
        learned, size = [[] for _ in range(k)], 0
        types, press = None, zstandard.ZstdCompressor(level=3)

        def close() -> Iterator[pa.RecordBatch]:
            n = len(table)
            counts = [np.bincount(np.concatenate(own), minlength=n) if own else np.zeros(n, np.int64) for own in learned]
            words = list(table)
            for at in range(0, n, 50_000):
                part = words[at:at + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, 1, np.int32)), pa.array(np.full(m, block)), pa.nulls(m, types),
                     pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), pa.array(part, pa.binary()),
                     pa.array(np.arange(at, at + m, dtype=np.int32)),
                     *[pa.array(c[at:at + m].astype(np.int64)) for c in counts]], names=[f.name for f in fields])

        for batch in batches:
            types = batch.column(0).type
            held, group = batch.column(2), batch.column(3).to_pylist()
            at = 0
            while at < len(group):
                codes, from_ = [], at
                while at < len(group) and size < block_bytes:
                    body = batch.column(1)[at].as_py()
                    own = np.array([table.setdefault(w, len(table)) for w in words_of(body)], np.int32)
                    if group[at] is not None:
                        learned[group[at]].append(own)
                    codes.append(_packed(own, press))
                    size += len(body) + 1
                    at += 1
                m = at - from_
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), pa.array(np.full(m, block)), batch.column(0)[from_:at],
                     held[from_:at], pa.array(codes, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()),
                     *[pa.nulls(m, pa.int64())] * k], names=[f.name for f in fields])
                if size >= block_bytes:
                    yield from close()
                    block, size = block + 1, 0
                    table.clear()
                    learned = [[] for _ in range(k)]
        if table:
            yield from close()

    schema = T.StructType(fields)
    path = scratch_path(rows.sparkSession, "lm-encoded")
    rows.select("id", "body", "held", "group").mapInArrow(encode, schema).write.partitionBy("kind").parquet(path)
    read = rows.sparkSession.read.schema(schema)
    return (read.parquet(path).where("kind = 0").select("block", "id", "held", "codes"),
            read.parquet(path).where("kind = 1").select("block", "at", "word", *[f"c{i}" for i in range(k)]))


def document_scores(docs: DataFrame, path: str, held_out: Column, id: str = "doc_id", text: str = "text",
                    component: str | None = "lang", rounds: int = 1, block_bytes: int = 32_000_000) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows where ``held_out`` is not true. Tokens are lower-cased words (A-Z) and one end a text; a null or
    empty text is its end alone. ``base_score`` is log10 under add-half word counts, ``score`` the log10 marginal
    probability under the lattice model. ``component`` names a column whose values are learned as components of the
    mixture; values with under a sixteenth of the training rows, and nulls, are one further component, so there are
    seventeen at most. The column is not read when a text is scored. Without training rows the pieces keep the
    weights of the file. Repeated rows are scored each by itself; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out, F.lit(False))
    label = F.coalesce(F.col(component).cast("string"), F.lit("")) if component else F.lit("")
    rows = plain(docs, id, text, held.alias("held"), label.alias("label"))
    sums = rows.where("not held").groupBy("label").agg(F.count("*").alias("n"))
    n_docs = sums.agg(F.sum("n")).first()[0] or 0
    large = {r["label"]: r["n"] for r in sums.where(F.col("n") >= n_docs / 16).where(F.col("label") != "").collect()}
    names = sorted(large)
    rest = n_docs - sum(large.values())
    if rest or not names:
        names.append(None)
    ends = np.array([large[n] if n is not None else rest for n in names], float)
    group = F.lit(len(names) - 1)
    for i, name in enumerate(names):
        if name is not None:
            group = F.when(F.col("label") == name, i).otherwise(group)
    rows = rows.withColumn("group", F.when(~F.col("held"), group))
    k = len(names)
    cs = [f"c{i}" for i in range(k)]
    coded, listed = _encode(rows, names, block_bytes)
    words = materialise(listed.groupBy("word").agg(*[F.sum(c).alias(c) for c in cs]), "lm-words")
    total = sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    found = words.agg(
        F.coalesce(F.sum(total), F.lit(0)).alias("n"), F.count(F.when(total > 0, 1)).alias("v"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n{i}") for i, c in enumerate(cs)],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"v{i}") for i, c in enumerate(cs)],
        *[F.count(F.when(F.col(c) == 1, 1)).alias(f"o{i}") for i, c in enumerate(cs)],
        *[F.count(F.when(F.col(c) == 2, 1)).alias(f"t{i}") for i, c in enumerate(cs)]).first()
    n_all, v_all = int(found["n"]) + n_docs, int(found["v"]) + (1 if n_docs else 0)
    n_words, v_words, once, twice = (np.array([found[f"{x}{i}"] for i in range(k)], float) for x in "nvot")

    pieces, weight = load_pieces(path)
    size, longest = len(weight), max(map(len, pieces))
    starts = np.zeros(size, bool)
    starts[[n for p, n in pieces.items() if p.startswith(SPACE)]] = True
    log_p = _normal(np.repeat(weight[:, None], k, axis=1) / weight.sum() * 1e4, starts, np.full(k, 3e3))
    sent = spark.sparkContext.broadcast((pieces, Trie(pieces, longest)))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Lattice]]:
        pieces, trie = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, WORDS):
                part = batch[at:at + WORDS]
                yield part, Lattice([w.decode("utf-8", "replace") for w in part.column(0).to_pylist()], pieces, longest, trie)

    for _ in range(rounds):
        now = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses = np.zeros((size, k))
            for part, lattice in batches_of(batches):
                counts = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
                uses += lattice.expected(lattice.weights(now.value), counts.astype(float), size)
            at = np.flatnonzero(uses.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *[pa.array(uses[at, i]) for i in range(k)]], names=["piece", *[f"u{i}" for i in range(k)]])

        told = words.where(total > 0).mapInArrow(expect, ", ".join(["piece bigint"] + [f"u{i} double" for i in range(k)]))
        uses = np.zeros((size, k))
        for row in told.groupBy("piece").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(k)]).collect():
            uses[row[0]] = row[1:]
        if n_all:
            log_p = _normal(uses, starts, n_words)
        now.unpersist()

    # inside a piece sequence the word ends with the weight that no further piece takes
    stop = np.log1p(-np.minimum(np.exp(log_p[~starts]).sum(axis=0), 1 - 1e-9))
    tokens = n_words + ends
    discount = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95)
    with np.errstate(divide="ignore"):
        spread = np.where(tokens > 0, np.maximum(discount * v_words, 1.0) / np.maximum(tokens + 1, 1), 0.5)
        end = np.log(np.where(tokens > 0, np.maximum(ends, 0.5) / np.maximum(tokens + 1, 1), 0.5))
        mixture = np.log(ends / ends.sum()) if ends.sum() else np.zeros(k)
    final = spark.sparkContext.broadcast(log_p)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lattice in batches_of(batches):
            spelled = lattice.forward(lattice.weights(final.value))[lattice.last] + stop
            counts = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            whole = np.where(counts > 0, (counts - discount) / np.maximum(tokens + 1, 1), 0)
            with np.errstate(divide="ignore"):
                log_w = np.logaddexp(np.log(whole), np.log(spread) + spelled)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts.sum(axis=1)), *[pa.array(log_w[:, i].astype(np.float32)) for i in range(k)]],
                names=["word", "c", *[f"w{i}" for i in range(k)]])

    ws = [f"w{i}" for i in range(k)]
    scored = words.mapInArrow(marginal, ", ".join(["word binary, c bigint"] + [f"{w} float" for w in ws]))
    # a frequent word has a row in every block; the adaptive skew rule splits that side of the join
    by_block = listed.select("block", "at", "word").join(scored, "word").select("block", "at", "c", *ws)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("held", T.BooleanType()),
                           *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")],
                           *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]])
    scale = np.log10(n_all + 0.5 * (v_all + 1))
    base_end = float(np.log10(n_docs + 0.5) - scale)

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        n = values.num_rows
        place = values.column("at").to_numpy()
        c = np.zeros(n, np.int64)
        c[place] = values.column("c").to_numpy()
        logs = np.zeros((n, k))
        for i in range(k):
            logs[place, i] = values.column(ws[i]).to_numpy()
        base = np.log10(c + 0.5) - scale
        out, press = [], zstandard.ZstdDecompressor()
        for raw in texts.column("codes"):
            codes = _unpacked(raw.as_py(), press)
            each = logs[codes].sum(axis=0) + end + mixture
            top = each.max()
            out.append((len(codes) + 1, int((c[codes] > 0).sum()) + (n_docs > 0), float(base[codes].sum() + base_end),
                        float((top + np.log(np.exp(each - top).sum())) / np.log(10))))
        columns = list(zip(*out)) if out else [()] * 4
        return pa.table([texts.column("id"), texts.column("held"), pa.array(columns[0], pa.int64()),
                         pa.array([int(x) for x in columns[1]], pa.int64()), pa.array(columns[2], pa.float64()),
                         pa.array(columns[3], pa.float64())],
                        names=["id", "held", "n_tokens", "n_known", "base_score", "score"])

    result = coded.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(score, schema)
    return result.select(F.col("id").alias(id), F.col("held").alias("held_out"), "n_tokens", "n_known",
                         F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
