"""Run the named queries next to their SQL and compare whole results.

    python tests/compare.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str):
    import duckdb

    link = duckdb.connect()
    for name in TABLES:
        link.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return link


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def difference(frame, link, text: str) -> str | None:
    """None when equal, else what differs first."""
    cursor = link.execute(text)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} / {sorted(names)}"
    found = rows_of(frame.columns, frame.collect())
    if found == expected:
        return None
    only_found = sorted(set(found) - set(expected))[:2]
    only_expected = sorted(set(expected) - set(found))[:2]
    return f"rows {len(found)} / {len(expected)}\n   here {only_found}\n   sql  {only_expected}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from stallwise.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    link, oracles, bad = connect(folder), oracle_sql(), []
    for name, run in queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in oracles:
                wrong = difference(frame, link, oracles[name])
                verdict = "equal" if wrong is None else wrong
            else:
                wrong, verdict = None, f"{len(frame.collect())} rows"
        except Exception as error:  # report and go on with the next query
            wrong = verdict = f"{type(error).__name__}: {str(error)[:700]}"
        if wrong:
            bad.append(name)
        print(f"{'BAD' if wrong else 'ok '} {name} {time.time() - start:.2f}s {verdict}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
