"""Row-by-row comparison of a registered query with its SQL equivalent.

Run as a script: ``python tests/oracle_check.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    if hasattr(value, "item"):
        return _plain(value.item())
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = canonical([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from tracemill.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        begun = time.time()
        try:
            if name in sql:
                verdict = compare(spark, con, name, query, sql[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {verdict} ({time.time() - begun:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
