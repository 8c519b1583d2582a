"""Near duplicates by SimHash, joined through the anchor points of a covering code.

The 64 bits are two halves; two fingerprints that differ in at most 2t+1 bits agree
up to t bits in one half. 31 bits of each half carry the Hamming code [31, 26]: every
point is within one bit (the covering radius) of a code word. A fingerprint goes to
each code word within radius + threshold bits of it, so any pair to be found meets
at the code word nearest to one of them and is compared there on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from stallwise.llm.common import fresh, plain, whole_text, words_of
from stallwise.session import materialise

#: Shingles whose bits are unpacked at once.
SLICE = 65_536
#: A fingerprint with more than one in this many of all rows is hot. Fewer than this many can be, so they are broadcast
#: to their rows; all others are merged by key.
HOT_SHARE = 1000
_HALF = np.uint64(0x7FFFFFFF)


def fingerprint(words: list[bytes], length: int) -> int:
    """Bit majority over the hashes of all shingles of ``length`` words; zero without words."""
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= length:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n - length + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[length - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = np.array(hashes[at:at + SLICE], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 3, *more: Column) -> DataFrame:
    """``id, fp`` (64 bits as a signed long) and ``more``, one row per input row. Null and empty texts have zero."""

    @F.pandas_udf("bigint")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.array([fingerprint(words_of(body), length) for body in batch], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return plain(docs, id, text).select(F.col("id").alias(id), of("body").alias("fp"), *more)


def _syndrome(points: np.ndarray) -> np.ndarray:
    """Of 31-bit points: the exclusive or of the numbers 1 to 31 of the bits that are set."""
    out = np.zeros(len(points), np.uint64)
    for bit in range(31):
        out ^= ((points >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def anchors(points: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """All code words at most ``within`` (1 or 2) bits from each point: (row, code word).

    A code word has no other one so near. Any other point has one at distance one, where the bit named by its
    syndrome s is flipped, and at distance two one for each pair of bit numbers whose exclusive or is s.
    """
    syndrome = _syndrome(points)
    rows, words = [np.flatnonzero(syndrome == 0)], [points[syndrome == 0]]
    rest = np.flatnonzero(syndrome)
    p, s = points[rest], syndrome[rest]
    one = np.uint64(1)
    rows.append(rest)
    words.append(p ^ (one << (s - one)))
    if within > 1:
        for first in range(1, 32):
            second = s ^ np.uint64(first)
            use = second > first
            rows.append(rest[use])
            words.append(p[use] ^ (one << np.uint64(first - 1)) ^ (one << (second[use] - one)))
    return np.concatenate(rows), np.concatenate(words)


def _pairs_near(anchor: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints of one anchor that differ in at most ``bits`` bits; rows sorted by anchor."""
    left, right = [], []
    step = 1
    while step < len(fp):
        same = np.flatnonzero(anchor[step:] == anchor[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same] ^ fp[same + step]) <= bits]
        left.append(fp[near])
        right.append(fp[near + step])
        step += 1
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def _spanning(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the first of its component, found without making all pairs.

    A point is compared with the points not yet reached; those it reaches leave that set. A dense group is used up
    by a few comparisons, whatever its size.
    """
    open_, left, right = fp, [], []
    while len(open_):
        root, frontier, open_ = open_[0], [open_[0]], open_[1:]
        while frontier and len(open_):
            near = np.bitwise_count(open_ ^ frontier.pop()) <= bits
            if near.any():
                reached, open_ = open_[near], open_[~near]
                frontier.extend(reached)
                left.append(reached)
                right.append(np.full(len(reached), root))
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, bits: int, many: int = 24) -> DataFrame:
    """``a, b``: links between fingerprints (column ``fp``, unique) that connect all that differ in ``bits`` bits or
    fewer. Within an anchor with over ``many`` members only spanning links are given."""
    if not 0 <= bits <= 3:
        raise ValueError("two halves and a radius of one serve distances from 0 to 3")
    within = 1 + bits // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), SLICE):
                part = fp[at:at + SLICE]
                for half in (0, 1):
                    rows, words = anchors((part >> np.uint64(32 * half)) & _HALF, within)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(words.view(np.int64) + (half << 40)), pa.array(part[rows].view(np.int64))],
                        names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_a, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def groups(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(anchor)) + 1
            starts = np.concatenate(([0], cut))
            sizes = np.diff(np.concatenate((starts, [len(anchor)])))
            of = np.repeat(sizes, sizes)
            small = (of > 1) & (of <= many)
            found = [_pairs_near(anchor[small], fp[small], bits)]
            for at, size in zip(starts[sizes > many].tolist(), sizes[sizes > many].tolist()):
                found.append(_spanning(fp[at:at + size], bits))
            a = np.concatenate([x for x, _ in found])
            b = np.concatenate([y for _, y in found])
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            anchor = np.concatenate((kept_a, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((kept_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(anchor):
                continue
            last = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on in the next batch
            if last:
                yield from groups(anchor[:last], fp[:last])
            kept_a, kept_f = anchor[last:], fp[last:]
        if len(kept_a):
            yield from groups(kept_a, kept_f)

    placed = distinct.select("fp").mapInArrow(place, "anchor bigint, fp bigint")
    dealt = placed.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components with fewer, shorter links: each task joins what its own rows connect."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent: dict[int, int] = {}
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                while (p := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(p, p)
                while (p := parent.get(y, y)) != y:
                    parent[y] = y = parent.get(p, p)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            out = []
            for x in parent:
                root = x
                while (p := parent.get(root, root)) != root:
                    root = p
                if root != x:
                    out.append((x, root))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(contract, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): root is the least node reachable.

    Large-star and small-star rounds; each round's links are a written table, so a lost executor costs one stage.
    """
    now = materialise(_contracted(edges), "simhash-links")
    state = None
    while True:
        both = now.union(now.select("b", "a")).where("a <> b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # each node now has links to smaller nodes only
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(small, "simhash-links")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b").distinct())


def _rooted(nodes: DataFrame, bits: int) -> DataFrame:
    """``nodes`` (``fp, least, n``) with the ``root`` of their component."""
    roots = components(links(nodes, bits))
    return materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 3,
                    bits: int = 3) -> DataFrame:
    """One row per input row: ``id, fp, component_id``.

    Documents are linked when their fingerprints differ in at most ``bits`` bits; ``component_id`` is the least id
    that links lead to, the own id included. Texts without words have fingerprint zero and are linked like any
    other. Equal fingerprints are one node, however many rows share it. A component whose ids are all null has a
    null id. An empty table gives no rows; further columns are not read.
    """
    marked = materialise(fingerprints(docs, id, text, length), "simhash")
    nodes = materialise(marked.groupBy("fp").agg(F.min(id).alias("least"), F.count("*").alias("n")), "simhash-nodes")
    rooted = _rooted(nodes, bits)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialise(rooted.join(named, "root").select("fp", "n", "component_id"), "simhash-components")
    share = nodes.agg(F.sum("n") / HOT_SHARE).scalar()
    hot, cold = (of.where(x).drop("n") for x in (F.col("n") > share, F.col("n") <= share))
    rest = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")
    return marked.join(F.broadcast(hot), "fp").unionByName(rest).select(id, "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 3,
                         bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component of linked fingerprints; all columns as they were.

    The row with the least id stays, a null id only if the component has no other; of rows that share this id the one
    whose text has the least SHA-256. Of rows that repeat id and text one stays. Rows are told apart by id and digest.
    """
    digest = F.unhex(F.sha2("body", 256)).alias("sha")
    marked = materialise(fingerprints(docs, id, text, length, digest).withColumnRenamed(id, "id"), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("least")
    nodes = materialise(marked.groupBy("fp").agg(first, F.count("*").alias("n")), "simhash-nodes")
    own, sha = fresh(docs, "key_id", "key_sha")
    kept = materialise(_rooted(nodes, bits).groupBy("root").agg(F.min("least").alias("least")).select(
        F.col("least.id").alias(own), F.col("least.sha").alias(sha)), "simhash-kept")
    repeated = marked.groupBy(F.col("id").alias(own), F.col("sha").alias(sha)).agg(
        F.count("*").alias("n")).where("n > 1")
    key = F.col(f"a.{own}").eqNullSafe(F.col(f"b.{own}")) & (F.col(f"a.{sha}") == F.col(f"b.{sha}"))
    kept_twice, kept_once = (materialise(kept.alias("a").join(repeated.alias("b"), key, how), "simhash-kept")
                             for how in ("left_semi", "left_anti"))
    here = F.unhex(F.sha2(whole_text(text), 256))
    same = (here == F.col(sha)) & F.col(id).eqNullSafe(F.col(own))
    # one plan for every size, as in exact dedup
    once = docs.join(kept_once.hint("merge"), same, "left_semi")
    again = docs.join(kept_twice, same, "left_semi").withColumn(sha, here).dropDuplicates([id, sha])
    return once.unionByName(again.drop(sha))


def hexadecimal(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
