"""Row-by-row comparison of a Spark result with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations").split()

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    return "null" if x is None else str(x)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> list[str]:
    """Human-readable differences; empty when schema and rows agree."""
    cursor = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in cursor.description}
    duck_columns, duck_rows = normal([d[0] for d in cursor.description], cursor.fetchall())
    columns, rows = normal(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if columns != duck_columns:
        return [f"columns {columns} != {duck_columns}"]
    for f in df.schema:
        want = SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
        if want != duck_types[f.name]:
            found.append(f"type of {f.name}: {want} != {duck_types[f.name]}")
    if len(rows) != len(duck_rows):
        found.append(f"rows {len(rows)} != {len(duck_rows)}")
    wrong = [(a, b) for a, b in zip(rows, duck_rows) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}")
    if not rows:
        found.append("empty result")
    return found


def main(sf_dir: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from tests.session import session

    spark, con = session(), connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = differences(df, con, oracles[name]) if name in oracles else [] if df.count() else ["empty"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {'; '.join(found)}", flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
