"""The prefix tree of conversations by burst tries.

Distinct sequences of turns are suffixes in containers under trie heads. A container
of too many is burst: its head becomes a node and its sequences go to containers by
their next turn. The containers that are left lie in sorted shards, and a sweep over
a shard opens and closes their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.llm.common import WORD
from stallwise.operators.joins import lookup_join
from stallwise.operators.ordered import running_count
from stallwise.session import materialise

#: Hexadecimal digits of a turn id, a digest of role and text.
WIDE = 32
#: Ids in one part of a list that is hashed, and turns in one step of a running sum.
IDS, STEP = 8192, 4096


def numbered_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """``conv, place, tid, words``: turns of each conversation from 1 by ``turn`` (null first), ties by turn id.

    The numbers come from a range partitioning with counts carried over, so a conversation with a third of all rows
    is cut. Null role and text count as empty; rows without a conversation id are left out.
    """
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    tid = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, WIDE)
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), tid.alias("tid"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))
    return running_count(turns, ["conv"], ["turn", "tid"], "place", "trie-order").drop("turn")


def rebuilt_turns(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Turns when each conversation c takes its first h = crc32(c) mod ``most`` from c - c mod ``every``."""
    base = F.col("conv") - F.col("conv") % every
    h = F.when(base == F.col("conv"), 0).otherwise(F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)))
    sizes = convs.select(F.col("conv").alias("base"), F.col("turns").alias("there"))
    plan = convs.select("conv", base.alias("base"), h.cast("long").alias("h")).join(sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    first = turns.where((F.col("conv") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    taken = plan.where("taken > 0").join(first, "base").where("place <= taken")
    own = turns.join(plan, "conv").where("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    columns = ["conv", "place", "tid", "words"]
    return taken.select(*columns).unionByName(own.select(*columns))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one key, comma-joined in parts of at most ``IDS``; the rows are sorted by (key, conv)."""
    key, ids, done = None, [], []

    def close() -> None:
        if ids:
            done.append((key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.string())], names=["key", "start", "ids"])
        done.clear()
        return batch

    for batch in batches:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            if k != key or len(ids) >= IDS:
                close()
                key = k
            ids.append(conv)
        yield rows()
    close()
    yield rows()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's list, part after part; the rows are sorted by (key, start)."""
    key, state, keys, found = None, None, [], []

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())],
                                           names=["key", "ends"])
        keys.clear()
        found.clear()
        return batch

    for batch in batches:
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k == key:
                state.update(b"," + part.encode())
                continue
            if state is not None:
                keys.append(key)
                found.append(state.hexdigest())
            key, state = k, hashlib.sha256(part.encode())
        yield rows()
    if state is not None:
        keys.append(key)
        found.append(state.hexdigest())
    yield rows()


def list_digests(members: DataFrame) -> DataFrame:
    """``key, ends``: SHA-256 of the comma-joined ``conv`` of each ``key``, rising.

    The ids are joined in the partitions of a sort over the cluster; the task that hashes a key reads one row for
    every ``IDS`` of its ids and holds one at a time.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "conv"]
    lists = members.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _lists, "key string, start long, ids string")
    return lists.repartition(parts, "key").sortWithinPartitions("key", "start").mapInArrow(
        _digests, "key string, ends string")


NODE = "depth long, conv long, parent long, n long, children long, leaves long, saved long, ends string, goes long, lead string"


class Node:
    """A node that the sweep has open: what its closed children and the sequences that end in it have brought."""

    __slots__ = ("depth", "words", "n", "first", "children", "leaves", "saved", "ends", "goes", "up")

    def __init__(self, depth: int, words: int, up: Node | None):
        self.depth, self.words, self.up = depth, words, up
        self.n = self.children = self.leaves = self.saved = 0
        self.first: int | None = None
        self.ends: str | None = None
        self.goes: int | None = None

    def members(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(first, self.first)

    def close(self) -> None:
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves if self.children else 1
        if self.up is not None:
            self.up.members(self.n, self.first)
            self.up.children += 1
            self.up.leaves += self.leaves
            self.up.saved += self.saved


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a shard; the rows are sorted by (lead, path)."""
    lead, before, made, ready = None, "", [], []
    node: Node | None = None

    def finish() -> None:
        nonlocal node
        while node is not None:
            node.close()
            node = node.up
        ready.extend((x, x.up.first if x.up else None, None if x.up else lead) for x in made)
        made.clear()

    def rows() -> pa.RecordBatch:
        columns = [
            [x.depth for x, _, _ in ready], [x.first for x, _, _ in ready], [p for _, p, _ in ready],
            [x.n for x, _, _ in ready], [x.children for x, _, _ in ready], [x.leaves for x, _, _ in ready],
            [x.saved for x, _, _ in ready], [x.ends for x, _, _ in ready], [x.goes for x, _, _ in ready],
            [t for _, _, t in ready]]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.int64(), pa.string()]
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          names=[part.split()[0] for part in NODE.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            path, sizes = row["path"], row["sizes"]
            if row["lead"] != lead:
                finish()
                lead = row["lead"]
                top = len(lead) // WIDE
                node = Node(top, sizes[top - 1] if top else 0, None)
                made.append(node)
                common = top
            else:
                common = len(commonprefix((path, before))) // WIDE
            while node.depth > common:
                node.close()
                node = node.up
            for depth in range(common, len(sizes)):
                node = Node(depth + 1, sizes[depth], node)
                made.append(node)
            node.members(row["n"], row["first"])
            if row["tail"] is None:
                node.ends = row["ends"]
            else:
                node.children += 1
                node.leaves += 1
                node.saved += (row["n"] - 1) * row["tail"]
                node.goes = row["first"]
            before = path
            if len(ready) > 10_000:
                yield rows()
    finish()
    yield rows()


def _prefix(path: str, depth: Column | int) -> Column:
    return F.substring(F.col(path), F.lit(1), F.lit(WIDE) * depth)


def _same_start(turns: DataFrame, longer: DataFrame, cut: int) -> bool:
    """Whether two of the sequences ``longer`` agree in their first ``cut`` turns."""
    marks = [F.bit_xor(F.xxhash64(*c)).alias(f"m{i}") for i, c in enumerate((("place", "tid"), ("tid", "place")))]
    starts = turns.where(F.col("place") <= cut).join(longer, "conv", "left_semi").groupBy("conv").agg(*marks)
    return not starts.groupBy("m0", "m1").count().where("count > 1").isEmpty()


def sequences(turns: DataFrame, convs: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Distinct sequences of turns, and how many turns of one are held in a row.

    Rows: ``first`` (smallest conversation with the sequence), ``n`` (how many have it), ``length``, ``ends`` (digest
    of their ids), ``path`` (turn ids one after another), ``sizes`` (words of each turn), ``tail`` (words of the turns
    that are not in the row; null when all are). Equality is that of two 64-bit sums over (place, turn id) and the
    length. A row holds ``longest`` turns; where longer sequences agree in that many the number doubles until they
    don't, so that what is cut off a row is shared with no other sequence.
    """
    marks = [F.bit_xor(F.xxhash64(*c)).cast("string") for c in (("place", "tid"), ("tid", "place"))]
    of = turns.groupBy("conv").agg(F.concat_ws(" ", F.count("*").cast("string"), *marks).alias("key"),
                                   F.count("*").alias("length"), F.sum("words").alias("all_words"))
    members = materialise(convs.select("conv").join(of, "conv", "left").select(
        "conv", F.coalesce("key", F.lit("")).alias("key"), *[F.coalesce(c, F.lit(0)).alias(c)
                                                             for c in ("length", "all_words")]), "trie-members")
    distinct = members.groupBy("key").agg(F.min("conv").alias("first"), F.count("*").alias("n"),
                                          F.first("length").alias("length"), F.first("all_words").alias("all_words"))
    distinct = materialise(distinct.join(list_digests(members.select("key", "conv")), "key").drop("key"), "trie-distinct")
    cut = longest
    while True:
        longer = distinct.where(F.col("length") > cut).select(F.col("first").alias("conv"))
        if longer.isEmpty() or not _same_start(turns, longer, cut):
            break
        cut *= 2
    held = turns.where(F.col("place") <= cut).join(distinct.select(F.col("first").alias("conv")), "conv", "left_semi")
    row = F.sort_array(F.collect_list(F.struct("place", "tid", "words")))
    held = held.groupBy(F.col("conv").alias("first")).agg(row.alias("row")).select(
        "first", F.array_join("row.tid", "").alias("path"), F.col("row.words").alias("sizes"))
    found = distinct.join(held, "first", "left")
    in_row = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(
        "first", "n", "length", "ends", F.coalesce("path", F.lit("")).alias("path"),
        F.coalesce("sizes", F.array().cast("array<bigint>")).alias("sizes"),
        F.when(F.col("length") > cut, F.col("all_words") - in_row).alias("tail")), cut


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences with the ``lead`` of their container, heads, sequences that end at a head).

    A lead is the path of the container's head. Containers of more than ``limit`` sequences burst by the next turn,
    level after level; only their sequences are looked at again.
    """
    live, depth = materialise(rows, "trie-sequences"), 0
    left: list[DataFrame] = []
    heads: list[DataFrame] = []
    ended: list[DataFrame] = []
    while True:
        live = live.withColumn("lead", _prefix("path", depth))
        words = F.get("sizes", F.lit(depth - 1)) if depth else F.lit(0).cast("long")
        big = materialise(live.groupBy("lead").agg(
            F.count("*").alias("sequences"), F.sum("n").alias("members"), F.min("first").alias("conv"),
            F.first(words).alias("words")).where(F.col("sequences") > limit), "trie-heads")
        if big.isEmpty():
            break
        marked = materialise(lookup_join(live, big.select("lead", F.lit(True).alias("burst")), "lead", "first"),
                             "trie-burst")
        left.append(marked.where("burst IS NULL").drop("burst"))
        heads.append(big.select("lead", F.lit(depth).cast("long").alias("depth"), "conv", "members", "words"))
        onward = marked.where("burst").drop("burst")
        ended.append(onward.where(F.size("sizes") == depth))
        live, depth = onward.where(F.size("sizes") > depth).drop("lead"), depth + 1
    left.append(live)

    def union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
        out = like.limit(0)
        for frame in frames:
            out = out.unionByName(frame)
        return out

    none = big.select("lead", F.lit(0).cast("long").alias("depth"), "conv", "members", "words")
    return union(left, live), union(heads, none), union(ended, live)


def _above(lead: str, from_: int) -> Column:
    """Depths of a lead's heads: 0 up to its own depth less ``from_``."""
    depth = (F.length(lead) / WIDE).cast("int")
    return F.explode(F.when(depth >= from_, F.sequence(F.lit(0), depth - from_)))


def _head_nodes(heads: DataFrame, tops: DataFrame, ended: DataFrame) -> DataFrame:
    """Nodes of the heads: what containers, lower heads and sequences that end there bring to each head above them."""
    depth = (F.length("lead") / WIDE).cast("int")
    zero = F.lit(0).cast("long")
    own = (F.col("members") - 1) * F.col("words")
    more = (F.col("n") - 1) * F.col("tail")
    none = F.lit(None)
    brought = [
        tops.select("lead", _above("lead", 1).alias("at"), "leaves", "saved",
                    F.lit(1).alias("step"), none.cast("string").alias("ends"), none.cast("long").alias("goes")),
        heads.select("lead", _above("lead", 0).alias("at"), zero.alias("leaves"), own.alias("saved"),
                     F.lit(1).alias("step"), none.cast("string").alias("ends"), none.cast("long").alias("goes")),
        ended.select("lead", _above("lead", 0).alias("at"), F.when(F.col("tail").isNotNull(), 1).otherwise(zero)
                     .alias("leaves"), F.coalesce(more, zero).alias("saved"),
                     F.when(F.col("tail").isNotNull(), 0).alias("step"),
                     F.when(F.col("tail").isNull(), F.col("ends")).alias("ends"),
                     F.when(F.col("tail").isNotNull(), F.col("first")).alias("goes"))]
    rows = brought[0].unionByName(brought[1]).unionByName(brought[2])
    child = F.coalesce((depth - F.col("step") == F.col("at")).cast("long"), zero)
    here = depth == F.col("at")
    sums = rows.select(_prefix("lead", F.col("at")).alias("lead"), "leaves", "saved", child.alias("children"),
                       F.when(here, F.col("ends")).alias("ends"), F.when(here, F.col("goes")).alias("goes")
                       ).groupBy("lead").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")],
                                             F.max("ends").alias("ends"), F.max("goes").alias("goes"))
    nodes = heads.join(sums, "lead")
    return nodes.select("depth", "conv", F.col("members").alias("n"), "children", "leaves", "saved", "ends", "goes",
                        "lead")


def _with_parent(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    above = heads.select(F.col("lead").alias("_above"), F.col("conv").alias("parent"))
    keyed = nodes.withColumn("_above", F.when(F.col("depth") > 0, _prefix("lead", F.col("depth") - 1)))
    return lookup_join(keyed, above, "_above", "conv", "left").drop("_above")


def _tails(turns: DataFrame, rows: DataFrame, nodes: DataFrame, cut: int) -> DataFrame:
    """Nodes beyond the turns that a row holds: chains of one sequence each, made turn by turn."""
    of = rows.where("tail IS NOT NULL").select("first", "n", "length", F.col("ends").alias("list"))
    joint = nodes.where("goes IS NOT NULL").select(F.col("goes").alias("first"), F.col("conv").alias("joint"))
    rest = lookup_join(turns.where(F.col("place") > cut), of.join(joint, "first").withColumnRenamed("first", "conv"),
                       "conv", "place", "inner").withColumn("step", F.floor(F.col("place") / STEP))
    after = Window.partitionBy("conv").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    later = rest.groupBy("conv", "step").agg(F.sum("words").alias("here")).select(
        "conv", "step", F.coalesce(F.sum("here").over(after), F.lit(0)).alias("later"))
    from_here = Window.partitionBy("conv", "step").orderBy(F.desc("place"))
    words = rest.withColumn("below", F.sum("words").over(from_here)).join(later, ["conv", "step"])
    last = F.col("place") == F.col("length")
    return words.select(
        F.col("place").alias("depth"), "conv", F.when(F.col("place") == cut + 1, F.col("joint")).otherwise(F.col("conv"))
        .alias("parent"), "n", (~last).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("n") - 1) * (F.col("below") + F.col("later"))).alias("saved"),
        F.when(last, F.col("list")).alias("ends"))


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rebuild: bool = False, limit: int = 256, longest: int = 4096) -> DataFrame:
    """One row per node of the prefix tree of conversations.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes of the subtree, itself included), ``saved_tokens`` (words that members after the first needn't
    compute, over the subtree), ``ends_sha256`` (digest of the ids that end here). ``rebuild`` lets conversations
    begin with turns of another one first.

    A null role or text counts as empty, a null turn comes first, equal turns stand in the order of their digests and
    repeated rows are turns of their own; rows without a conversation id are left out. An empty table has no nodes.
    Copies of a conversation are one sequence with a count, a container holds at most ``limit`` sequences, and a
    row at most ``longest`` turns (more only where different conversations agree in more), so neither many copies,
    a common beginning nor one endless conversation meets in one task. Further columns are not read.
    """
    turns = materialise(numbered_turns(rows, conv, turn, role, text), "trie-turns")
    convs = materialise(turns.groupBy("conv").agg(F.count("*").alias("turns")), "trie-convs")
    if rebuild:
        turns = materialise(rebuilt_turns(turns, convs), "trie-rebuilt")
    found, cut = sequences(turns, convs, longest)
    placed, heads, ended = burst(found, limit)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = placed.select("lead", "path", "sizes", "n", "first", "ends", "tail").repartition(
        parts, "lead").sortWithinPartitions("lead", "path")
    swept = materialise(shards.mapInArrow(_sweep, NODE), "trie-swept")
    inner = swept.where("lead IS NULL").drop("lead")
    tops = swept.where("lead IS NOT NULL")
    upper = tops.drop("parent").unionByName(_head_nodes(heads, tops, ended))
    upper = _with_parent(upper, heads).drop("lead")
    nodes = inner.unionByName(upper)
    longer = found.where("tail IS NOT NULL")
    if not longer.isEmpty():
        nodes = materialise(nodes, "trie-nodes")
        nodes = nodes.drop("goes").unionByName(_tails(turns, longer, nodes, cut))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(empty)).alias("ends_sha256"))
