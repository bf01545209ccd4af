"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from foliant.catalog.registry import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "quantize"):
        return float(value)
    return value


timing: list[tuple[float, float, int]] = []


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """What differs between a result and the SQL, or None."""
    start = time.time()
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    timing.append((spent, time.time() - start - spent, sum(got.values())))
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    return f"{sum(got.values())} rows, {sum(want.values())} expected; extra {list((got - want))[:2]}; missing {list((want - got))[:2]}"


def main() -> None:
    from foliant.catalog import all_queries, all_sql
    from foliant.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries, oracle = all_queries(), all_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                problem = difference(df, connect(folder), oracle[name])
                n = ""
            else:
                problem, n = None, f"{len(df.collect())} rows only"
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", ""
        if name in oracle and timing:
            n = "spark {:.1f}s duckdb {:.1f}s {} rows".format(*timing[-1])
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {n} {problem or ''}"[:900], flush=True)
        bad += [name] if problem else []
    print(f"{len(names or queries)} queries, {len(bad)} differ: {bad}")


if __name__ == "__main__":
    main()
