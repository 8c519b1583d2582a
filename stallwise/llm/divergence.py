"""How far the sources of a language differ in their use of words, over run-length columns.

The vocabulary of a language is put in an order that brings terms of like counts
together. In that order a source's counts are a column of few runs; two columns are
compared run by run: where runs meet, the divergence of one term times the length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.operators.joins import lookup_join
from stallwise.session import materialise

#: Shares are in parts of this.
UNIT = 1_000_000_000
#: Counts above zero in one chunk of the vocabulary order, sources in one block, meetings of runs at once.
CELLS, BLOCK, MEETINGS = 100_000, 48, 1_000_000
#: Terms a task holds before it passes its counts on, and bytes of one text that are split at once.
HELD, PART = 400_000, 1 << 22

#: ASCII letters folded to lower case and bytes from 0x80 on are term bytes; other ASCII parts terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in lists, each of about ``PART`` bytes of text."""
    raw = (text or "").encode("utf-8", "replace").translate(_FOLDED)
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + PART)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a row without term names each group seen."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(terms) + 1), pa.repeat(source, len(terms) + 1),
                 pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()),
                 pa.array([*map(docs.__getitem__, terms), 0], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text"))):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in terms_of(text.as_py()):
                n.update(terms)
                new = set(terms).difference(seen)
                docs.update(new)
                seen |= new
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from rows()
    yield from rows()


def share(n, total, size):
    """1 + floor(UNIT * (n + 1) / (total + size)), digit by digit so that no product leaves 64 bits."""
    rest, found = n + 1, 0
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // (total + size)
        rest = rest % (total + size)
    return found + 1


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal counts at neighbouring places, by source, in chunks of about ``CELLS`` counts of one language.

    The rows come in the vocabulary order, all of a term together. Each chunk also gives a row without source that has
    the number of its places.
    """
    pending: list[pa.RecordBatch] = []
    made = 0

    def chunk(rows: pa.Table, place: np.ndarray) -> pa.RecordBatch:
        nonlocal made
        source = rows.column("source").combine_chunks().dictionary_encode()
        who, n = source.indices.to_numpy(), rows.column("n").to_numpy()
        order = np.lexsort((place, who))
        who, n, at = who[order], n[order], place[order]
        breaks = (who[1:] != who[:-1]) | (n[1:] != n[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
        length = np.diff(np.append(first, len(at)))
        names = pa.concat_arrays([source.dictionary.take(pa.array(who[first])), pa.array([None], pa.string())])
        made += 1
        return pa.RecordBatch.from_arrays(
            [pa.repeat(rows.column("lang")[0], len(names)),
             pa.array(np.full(len(names), (rows.column("part")[0].as_py() << 32) + made)), names,
             pa.array(np.append(at[first], 0)), pa.array(np.append(length, place[-1] + 1)),
             pa.array(np.append(n[first], -1))],
            names=["lang", "chunk", "source", "start", "length", "n"])

    def cut(end: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(pending).combine_chunks()
        pending.clear()
        other = np.zeros(len(rows), bool)  # another language than the row before, another term
        other[1:] = pc.not_equal(rows.column("lang")[1:], rows.column("lang")[:-1]).to_numpy()
        new = other.copy()
        new[1:] |= pc.not_equal(rows.column("term")[1:], rows.column("term")[:-1]).to_numpy()
        stops = [*np.flatnonzero(other).tolist(), len(rows)]
        start = 0
        for stop in stops:
            while stop - start > CELLS or end or stop < len(rows):
                terms = np.flatnonzero(new[start:min(start + CELLS, stop)])
                whole = stop if stop - start <= CELLS else start + int(terms[-1]) if len(terms) and terms[-1] else None
                if whole is None:  # more sources than cells of a chunk have this term
                    after = np.flatnonzero(new[start + 1:stop])
                    if not len(after) and not end and stop == len(rows):
                        break
                    whole = start + 1 + int(after[0]) if len(after) else stop
                yield chunk(rows.slice(start, whole - start), np.cumsum(new[start:whole]) - int(new[start]))
                start = whole
                if start == stop:
                    break
        if start < len(rows):
            pending.extend(rows.slice(start).to_batches())

    for batch in batches:
        if len(batch):
            pending.append(batch)
        if sum(map(len, pending)) > 2 * CELLS:
            yield from cut(False)
    if pending:
        yield from cut(True)


def columns_of(rows: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(source, run starts with the end of the chunk at the back, share of each run) of each source.

    ``rows`` holds the runs of counts above zero and, with n = -1, one row per source that spans the chunk; what
    no run covers is a run of zeros.
    """
    out = []
    order = np.lexsort((rows["n"] >= 0, rows["source"]))
    rows = {c: v[order] for c, v in rows.items()}
    marks = np.flatnonzero(rows["n"] < 0)
    for at, stop in zip(marks, [*marks[1:], len(order)]):
        base, size = int(rows["start"][at]), int(rows["length"][at])
        total, terms = int(rows["total"][at]), int(rows["terms"][at])
        own = slice(at + 1, stop)
        by_start = np.argsort(rows["start"][own])
        start, length, n = (rows[c][own][by_start] for c in ("start", "length", "n"))
        gap = np.concatenate([[base], start + length])
        starts = np.column_stack([gap, np.append(start, base + size)]).ravel()[:-1]  # zeros, run, zeros, run, .., zeros
        counts = np.column_stack([np.zeros(len(gap), np.int64), np.append(n, 0)]).ravel()[:-1]
        ends = np.append(starts[1:], base + size)
        filled = ends > starts
        out.append((str(rows["source"][at]), np.append(starts[filled], base + size),
                    share(counts[filled], total, terms)))
    return out


def compare(a: tuple, others: list[tuple]) -> list[int]:
    """For one column, the divergence from each of the others, summed over the chunk.

    Every run of the others is cut at the borders of the column's runs.
    """
    _, borders, p = a
    if not len(p):
        return [0] * len(others)
    totals: list[int] = []
    start = np.concatenate([b[1][:-1] for b in others])
    stop = np.concatenate([b[1][1:] for b in others])
    q = np.concatenate([b[2] for b in others])
    first = np.searchsorted(borders, start, "right") - 1
    meets = np.searchsorted(borders, stop, "left") - first
    one = np.repeat(np.arange(len(start)), meets)
    mine = np.arange(len(one)) - np.repeat(np.cumsum(meets) - meets, meets) + first[one]
    length = np.minimum(borders[mine + 1], stop[one]) - np.maximum(borders[mine], start[one])
    apart = p[mine] - q[one]
    value = apart * apart // q[one] * length
    runs = np.array([len(b[2]) for b in others])
    at = np.concatenate([[0], np.cumsum(meets)])[np.concatenate([[0], np.cumsum(runs)[:-1]])]
    totals += np.add.reduceat(value, at).tolist()
    return totals


def _pairs(table: pa.Table) -> pa.Table:
    side = table.column("side").to_numpy()
    names = ("source", "start", "length", "n", "total", "terms")
    whole = {c: table.column(c).to_numpy(zero_copy_only=False) for c in names}
    left, right = (columns_of({c: v[side == s] for c, v in whole.items()}) for s in (0, 1))
    found: list[tuple[str, str, int]] = []
    for a in left:
        group: list[tuple] = []
        size = 0
        for b in [*(b for b in right if b[0] != a[0]), None]:
            if group and (b is None or size + len(a[2]) + len(b[2]) > MEETINGS):
                found += [(a[0], o[0], v) for o, v in zip(group, compare(a, group))]
                group, size = [], 0
            if b is not None:
                group.append(b)
                size += len(a[2]) + len(b[2])
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()),
                     "source": pa.array([f[0] for f in found], pa.string()),
                     "item": pa.array([f[1] for f in found], pa.string()),
                     "value": pa.array([f[2] for f in found], pa.int64())})


def _share(n: str, total: str) -> Column:
    """``share`` as a column, in decimals."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))) "
                  f"div cast({total} + terms as decimal(19, 0))")


class Divergence:
    """Counts of kept terms, stored; ``runs``, ``pairs`` and ``terms`` derive the figures.

    Null text, language or source count as empty. A term is a run of ASCII letters and of all characters beyond ASCII,
    A-Z lower-cased; a language keeps those in at least ``least`` of its rows (a repeated row counts again). Texts
    are split in parts, so a very long one needs no more memory than its own set of terms. An empty table has no
    groups; a language without kept terms has groups that differ by 0. Further columns are not read.

    Counts are taken per task before they are dealt by (language, term), so a language, a source or a term with
    a third of all rows sends few rows. The vocabulary order is a range partitioning, cut in chunks.
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3):
        rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                             for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
        counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        # dealt once by (lang, term): the sums by group and those by term both find their rows in place
        counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
            F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        term = Window.partitionBy("lang", "term")
        marked = counts.select(
            "lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"),
            F.min(F.struct("source", "n")).over(term).alias("first"),
            F.bit_xor(F.xxhash64("source", "n")).over(term).alias("same"))
        stored = materialise(marked.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs"),
                             "divergence-counts")
        self.cells = stored.where("term IS NOT NULL")
        sums = self.cells.groupBy("lang", "source").agg(
            F.sum("n").alias("total"), F.count_if(F.col("first.source") == F.col("source")).alias("terms"))
        groups = stored.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left")
        of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("terms").alias("terms"),
                                             F.sum("total").alias("lang_total"))
        self.groups = materialise(groups.drop("terms").join(of_lang, "lang").select(
            "lang", "source", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")]),
            "divergence-groups")

    def runs(self) -> DataFrame:
        """Run-length columns: ``lang, chunk, source, start, length, n`` for counts above zero.

        A row without source (n = -1) has the number of places of a chunk. Terms are in the order of their count in
        the language, the least source that has them, and a digest of all their counts, so that terms with the same
        counts in the same sources are neighbours.
        """
        parts = int(self.cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = ["lang", "lang_n", "first", "same", "term"]
        placed = self.cells.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return placed.select(F.spark_partition_id().alias("part"), "lang", "term", "source", "n").mapInArrow(
            _encoded, "lang string, chunk long, source string, start long, length long, n long")

    def pairs(self) -> DataFrame:
        """``lang, source, item, value`` for each ordered pair of sources of a language.

        Every chunk of the order is compared by itself and the chunks are added up. Languages of many sources are
        compared in blocks of about ``BLOCK`` sources against blocks, so a task holds two blocks of one chunk.
        """
        found = materialise(self.runs(), "divergence-runs")
        chunks = found.where("source IS NULL").drop("source")
        none = self.groups.where("terms = 0").select(
            "lang", *[F.lit(x).cast("long").alias(c) for c, x in (("chunk", 0), ("start", 0), ("length", 0), ("n", -1))]
        ).distinct()
        figures = self.groups.select("lang", "source", "total", "terms",
                                     F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"))
        spans = chunks.unionByName(none).join(figures, "lang")
        runs = lookup_join(found.where("source IS NOT NULL"), figures, ["lang", "source"], "start", "inner")
        rows = spans.unionByName(runs).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        left = rows.select("*", F.lit(0).alias("side"), F.col("block").alias("here"), every.alias("there"))
        right = rows.select("*", F.lit(1).alias("side"), every.alias("here"), F.col("block").alias("there"))
        parts = left.unionByName(right).drop("block", "blocks").groupBy("lang", "chunk", "here", "there").applyInArrow(
            _pairs, "lang string, source string, item string, value long")
        return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self) -> DataFrame:
        """``lang, source, item, value`` for each term that a source uses more, by share, than its language."""
        rows = lookup_join(self.cells, self.groups, ["lang", "source"], "term", "inner")
        rows = rows.select("lang", "source", F.col("term").alias("item"),
                           _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
        return rows.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """Adds ``part`` and ``rank`` within (language, source): value falling, then item rising."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if most is None else rows.where(F.col("rank") <= most)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
