"""Run registered queries against their oracle SQL and report differences.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value: object) -> str:
    if isinstance(value, float):
        return f"{value:.9g}"
    return repr(value)


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark_frame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[str | None, int]:
    """None when both sides agree, else a short description; and the row count."""
    got_columns = list(spark_frame.columns)
    got = normal_rows(got_columns, [tuple(r) for r in spark_frame.collect()])
    cursor = connection.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = normal_rows(want_columns, cursor.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} vs {sorted(want_columns)}", len(got)
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n  columns {sorted(got_columns)}\n  spark only {extra}\n  oracle only {missing}", len(got)
    return None, len(got)


def main() -> int:
    from pagefacts import session
    from pagefacts.plans import registry

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = session.build("compare", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    connection = open_oracle(sf_dir)
    queries, oracles = registry.queries(), registry.oracles()
    bad = 0
    for name in args or list(queries):
        started = time.time()
        try:
            frame = queries[name](spark, sf_dir)
            if name in oracles:
                problem, count = difference(frame, connection, oracles[name])
            else:
                problem, count = None, len(frame.collect())
        except Exception as error:  # noqa: BLE001
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", 0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name:28s} {count:7d} rows {time.time() - started:6.1f}s"
              + ("" if name in oracles else "  (no oracle)") + (f"\n  {problem}" if problem else ""), flush=True)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
