"""Compare registered queries with their SQL, by columns, row count and sorted values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(spark, connection, sf_dir: str, query, sql: str) -> tuple[int, str | None]:
    df = query(spark, sf_dir)
    columns, actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected_columns, expected = _rows(names, cursor.fetchall())
    if columns != expected_columns:
        return len(actual), f"columns {columns} != {expected_columns}"
    if len(actual) != len(expected):
        return len(actual), f"{len(actual)} rows, expected {len(expected)}"
    for a, e in zip(actual, expected):
        if a != e:
            return len(actual), f"{a} != {e}"
    return len(actual), None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from gainsay.session import local_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark, duck = local_session(8), connect(folder)
    failed = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            count, problem = compare(spark, duck, folder, run, entry.oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            count, problem = -1, str(error)[:600]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={count} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
