"""Run queries and their SQL on the same tables and compare all rows.

    python tests/compare.py FOLDER [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder.rstrip('/')}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value if isinstance(value, (int, str, type(None))) else repr(value)


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and the result of SQL; empty if nothing does."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _sorted_rows(names, cursor.fetchall())
    actual = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} but SQL has {sorted(names)}"]
    found = []
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows but SQL has {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}")
    return found


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from kindred.session import build_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql, bad = oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                found = differences(query(spark, folder), con, sql[name])
                state = "; ".join(found) or "equal"
            else:
                found, state = [], f"{query(spark, folder).count()} rows, no SQL"
        except Exception as error:  # keep going, report all
            found = [repr(error)]
            state = f"failed: {str(error)[:1500]}"
        bad += bool(found)
        print(f"{name:20} {time.time() - start:6.1f}s  {state}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
