"""Run every query beside its SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``.

Compares row count, column names and the sorted rows, value by value.
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from vitrine.plans.binding import TABLES  # noqa: E402
from vitrine.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return (type(value).__name__, value.isoformat())
    return (type(value).__name__, repr(value))


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        tuple(plain(row[i]) for i in order) for row in rows
    )


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want_names, want = rows_of(names, cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} of {len(got)} rows differ, e.g. {wrong[0]}" if wrong else None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark, con, failed = local_session(), connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name in chosen:
        start = time.time()
        try:
            if name not in oracles:
                outcome = f"no SQL; {entry.queries()[name](spark, sf_dir).count()} rows"
            else:
                outcome = compare(spark, con, sf_dir, name)
                failed += outcome is not None
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome, failed = f"{type(error).__name__}: {str(error)[:600]}", failed + 1
        print(f"{name:28} {time.time() - start:6.2f}s {outcome or 'ok'}", flush=True)
    print(f"{len(chosen)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
