"""Run queries in Spark and their reference SQL in DuckDB, and compare the rows.

Usage: python tests/compare.py SF_DIR [QUERY ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from boxline.plans import oracle_pages  # noqa: E402, F401
from boxline.plans.oracle import ORACLE  # noqa: E402
from boxline.plans.queries import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return value


def key(row):
    return tuple((v is not None, str(type(v).__name__), round(v, 3) if isinstance(v, float) else v) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: str(key(r)))


def differs(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is not b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return type(a) is not type(b) or a != b
    return a != b


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    columns, ours = rows_of(df.columns, df.collect())
    if name not in ORACLE:
        return f"rows only ({len(ours)})"
    result = con.execute(ORACLE[name])
    wanted_columns, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"COLUMNS differ: {set(columns) ^ set(wanted_columns)}"
    if len(ours) != len(wanted):
        extra, missing = set(ours) - set(wanted), set(wanted) - set(ours)
        return f"ROWS differ: {len(ours)} against {len(wanted)}; extra {list(extra)[:2]}; missing {list(missing)[:2]}"
    bad = [(c, a, b) for mine, theirs in zip(ours, wanted) for c, a, b in zip(columns, mine, theirs) if differs(a, b)]
    if bad:
        return f"VALUES differ in {len(bad)} cells of {sorted({c for c, _, _ in bad})}: {bad[:4]}"
    return f"ok ({len(ours)})"


def main() -> int:
    from boxline.sources.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            outcome = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            outcome = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        failed += not outcome.startswith(("ok", "rows only"))
        print(f"{name:32s} {time.time() - start:6.1f}s  {outcome}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
