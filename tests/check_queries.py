"""Compare every query with its SQL oracle; also usable from the command line.

    python tests/check_queries.py [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        cells = []
        for value in row:
            if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
                cells.append("~")
            elif isinstance(value, pd.Timestamp):
                cells.append(value.isoformat())
            elif isinstance(value, float):
                cells.append(str(int(value)) if value.is_integer() else f"{value:.9g}")
            elif hasattr(value, "isoformat"):
                cells.append(value.isoformat()[:10])
            else:
                cells.append(str(value))
        rows.append(tuple(cells))
    return sorted(rows)


def compare(spark, folder: str, name: str, make, sql: str | None) -> tuple[bool, str]:
    got = make(spark, folder).toPandas()
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no oracle"
    want = connect(folder).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    have, expect = normal(got), normal(want)
    if have != expect:
        extra = [r for r in have if r not in set(expect)][:2]
        lost = [r for r in expect if r not in set(have)][:2]
        return False, f"{len(have)} vs {len(expect)} rows; only here {extra}; only oracle {lost}"
    return True, f"{len(have)} rows equal"


def main() -> int:
    import __spark_entry__ as entry
    from threadlake.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = entry.oracle_sql(), 0
    for name, make in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            good, note = compare(spark, folder, name, make, oracles.get(name))
        except Exception as problem:  # noqa: BLE001
            good, note = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
