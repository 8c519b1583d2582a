"""Logs with deletions by file, first rows over batches, CSV files read in ranges."""

import datetime as dt
import os
import random

import pytest

from stallwise.operators.clean import first_per_name
from stallwise.schemas import MESSAGE, RAW_PRODUCT_COLUMNS
from stallwise.sources.arrivals import FirstSeen, keep_first
from stallwise.sources.file_log import FileLog
from stallwise.sources.large_csv import read_split_products, records
from stallwise.sources.readers import read_products

START = dt.datetime(2024, 1, 1)


def messages(spark, first, n, sessions):
    rows = [(i, None if i % 97 == 0 else f"s{i % sessions:02}", "user", f"m{i}", START + dt.timedelta(minutes=i))
            for i in range(first, first + n)]
    return spark.createDataFrame(rows, MESSAGE)


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_deletion_rewrites_touched_files_alone(spark, tmp_path):
    log = FileLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.files() == {}
    log.append(messages(spark, 0, 400, 40), parts=10)
    log.append(messages(spark, 400, 200, 40), parts=4)
    before, every = log.files(), ids(log.read())
    gone = spark.createDataFrame([("s03",), ("s03",), ("s04",), (None,), ("never",)], "session_id string")
    done = log.delete_sessions(gone)
    left = {r["id"]: r["session_id"] for r in log.read().collect()}
    assert sorted(left) == [i for i in every if i % 97 == 0 or i % 40 not in (3, 4)]
    assert None in left.values()                                   # null names no session and none is taken for it
    assert 1 <= done.rewritten + done.dropped <= 5 and done.linked == len(before) - done.rewritten - done.dropped
    assert len(set(before) & set(log.files())) == done.linked      # the other files are the same files
    assert done.rows_written <= sum(sorted(before.values())[-5:])
    assert ids(log.read(version=2)) == every                       # the version before is still there
    version = log.version()
    assert log.delete_sessions(gone) == (len(log.files()), 0, 0, 0) and log.version() == version
    log.append(messages(spark, 600, 10, 40), parts=1)
    assert len(left) + 10 == log.read().count()


def test_stopped_deletion_and_cleaning(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log = FileLog(spark, path)
    log.append(messages(spark, 0, 200, 10), parts=5)
    every = ids(log.read())
    monkeypatch.setattr(log, "_publish", lambda files: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        log.delete_sessions(spark.createDataFrame([("s01",)], "session_id string"))
    monkeypatch.undo()
    os.makedirs(f"{path}/manifest/version=2")                       # a manifest that was begun and not finished
    assert log.version() == 1 and ids(log.read()) == every
    log.delete_sessions(spark.createDataFrame([("s01",)], "session_id string"))
    kept = ids(log.read())
    assert log.version() == 2 and kept == [i for i in every if i % 97 == 0 or i % 10 != 1]
    assert log.clean() > 1 and ids(log.read()) == kept and log.version() == 2
    here = {f"{d}/{f}" for d in os.listdir(f"{path}/data") for f in os.listdir(f"{path}/data/{d}") if f.endswith(".parquet")}
    assert here == set(log.files())
    log.delete_sessions(log.read())                                 # all sessions: only rows without one are left
    assert all(i % 97 == 0 for i in ids(log.read()))


NAMED = "ord long, product_name string, price string"


def named_rows(n):
    rng = random.Random(5)
    return [(i, None if rng.random() < 0.05 else f"p{rng.randrange(n // 4)}", f"{i}") for i in range(n)]


def test_any_split_into_batches_gives_the_first_rows(spark, tmp_path):
    rows = named_rows(400)
    want = sorted(map(tuple, first_per_name(spark.createDataFrame(rows, NAMED)).collect()))
    for split in range(3):
        rng = random.Random(split)
        mixed = rows if split == 0 else rng.sample(rows, len(rows))
        cuts = [0, *sorted(rng.sample(range(1, 400), 3)), 400]
        store = FirstSeen(spark, str(tmp_path / f"s{split}"), ["product_name"], "ord", NAMED, buckets=3)
        for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = spark.createDataFrame(mixed[a:b], NAMED)
            new = store.add(part, batch)
            if batch == 1:
                assert sorted(map(tuple, new.collect())) == sorted(map(tuple, store.add(part, batch).collect()))
            if batch == split:
                store.table.merge()
        assert sorted(map(tuple, store.read().collect())) == want
        store.table.merge()
        assert store.table.clean() > 0 and sorted(map(tuple, store.read().collect())) == want
        assert store.add(spark.createDataFrame(rows, NAMED), 9).count() == 0


def test_first_rows_of_a_stream(spark, tmp_path):
    rows = named_rows(200)
    for i in range(4):
        spark.createDataFrame(rows[::-1][i * 50:(i + 1) * 50], NAMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(NAMED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = FirstSeen(spark, str(tmp_path / "store"), ["product_name"], "ord", NAMED, buckets=2)
    keep_first(stream, store, str(tmp_path / "check"), merge_every=2).awaitTermination()
    want = sorted(map(tuple, first_per_name(spark.createDataFrame(rows, NAMED)).collect()))
    assert store.table.version() == 2 and sorted(map(tuple, store.read().collect())) == want


def product(i, **more):
    return {**{c: f"{c} {i}" for c in RAW_PRODUCT_COLUMNS}, **more}


def write_csv(path, rows, end="\n", header=RAW_PRODUCT_COLUMNS):
    def field(value):
        return '"' + value.replace('"', '""') + '"' if value is not None and any(c in value for c in ',"\r\n') else value or ""
    lines = [",".join(header), *[",".join(field(r[c]) for c in RAW_PRODUCT_COLUMNS) for r in rows]]
    path.write_bytes((end.join(lines) + end).encode())


def by_order(frame):
    return [tuple(r)[:-1] for r in sorted(frame.collect(), key=lambda r: tuple(r["ord"]))]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [61, 200, 5000])
def test_ranges_give_the_rows_of_one_task(spark, tmp_path, end, size):
    rng = random.Random(size)
    parts = ['say ""', "\n", "\n\n", "a,b", '"', " ", "₹1,099", "日本", '",\n"', "N/A", "\n" * 30 + "far"]
    rows = [product(i, about_product="".join(rng.choices(parts, k=rng.randint(0, 5))),
                    review_content="long text " * rng.choice([0, 1, 60]), rating=rng.choice(["N/A", "4.1", None]))
            for i in range(40)]
    (tmp_path / "csv").mkdir()
    write_csv(tmp_path / "csv" / "a.csv", rows[:25], end)
    write_csv(tmp_path / "csv" / "b.csv", rows[25:], end)
    path = str(tmp_path / "csv")
    want = by_order(read_products(spark, path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = read_split_products(spark, path)
        ranges = found.select("ord.file", "ord.block").distinct().count()
        got = by_order(found)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(want) == 40 and got == want
    assert ranges > 2  # one task a file would be two


def test_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    write_csv(tmp_path / "csv" / "a.csv", [product(1)])
    write_csv(tmp_path / "csv" / "b.csv", [product(2)], header=RAW_PRODUCT_COLUMNS[::-1])
    with pytest.raises(ValueError, match="header"):
        read_split_products(spark, str(tmp_path / "csv"))


def test_records_are_put_together_where_they_are(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    write_csv(tmp_path / "csv" / "a.csv", [product(i) for i in range(5)])
    plan = read_split_products(spark, str(tmp_path / "csv"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def split_at_line_breaks(text):
    """Records by reading sign for sign."""
    found, quoted, record = [], False, ""
    for sign in text + "\n":
        quoted ^= sign == '"'
        if sign == "\n" and not quoted:
            found.append(record.removesuffix("\r"))
            record = ""
        else:
            record += sign
    last = [record.removesuffix("\n")] if quoted else []  # the line break that ends the file is not of the record
    return [r for r in found + last if r]


def test_any_text_is_cut_into_its_records(spark, tmp_path):
    rng = random.Random(7)
    (tmp_path / "csv").mkdir()
    want = {}
    for i, signs in enumerate([rng.randrange(300, 500) for _ in range(4)] + [5, 9, 9, 1]):
        text = "".join(rng.choices(['"', "\n", "a", ",", "日", "\r\n"], [1, 4, 9, 1, 2, 1], k=signs))
        (tmp_path / "csv" / f"{i}.csv").write_bytes((text + ("" if i % 2 else "\n")).encode())
        want[f"{i}.csv"] = split_at_line_breaks(text)
    settings = {"spark.sql.files.maxPartitionBytes": 90, "spark.sql.files.openCostInBytes": 0}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = records(spark, str(tmp_path / "csv")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows.sort(key=lambda r: (r["file"], r["block"], r["place"]))
    got = {name: [r["record"] for r in rows if r["file"].endswith("/" + name)] for name in want}
    assert got == want
    assert len({(r["file"], r["block"]) for r in rows}) > 12 and any("\n" in r["record"] for r in rows)


def test_records_inside_a_range_are_not_shuffled(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    write_csv(tmp_path / "csv" / "a.csv", [product(i, about_product="two\nlines") for i in range(5)])
    found = records(spark, str(tmp_path / "csv"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a shuffle for records that cross the end of a range, nothing that sorts or deals out the lines
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Join" not in plan
    assert found.count() == 6


def test_a_header_that_crosses_ranges_is_checked(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_bytes(b'"a\nb",c\n1,2\n')
    (tmp_path / "csv" / "b.csv").write_bytes(b'"a' + b"\n" * 90 + b'b",c\n1,2\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40)
    try:
        with pytest.raises(ValueError, match="b.csv has another header"):
            read_split_products(spark, str(tmp_path / "csv"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
