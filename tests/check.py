"""Run registered queries against their SQL checks in DuckDB: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from casemill import build_session  # noqa: E402
from casemill.plans import fixtures  # noqa: E402


def _value(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_value(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for name in fixtures.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, name, sf_dir):
    df = contract.queries()[name](spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return "rows only", len(ours), ""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    theirs = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(ours), f"{sorted(df.columns)} vs {sorted(columns)}"
    types = [f"{c}:{k}/{kinds[c]}" for c, k in df.dtypes if _KINDS.get(k, k) != kinds[c]]
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    note = f"types {types}" if types else ""
    if a != b:
        left = [r for r in a if r not in set(b)][:3] if len(a) < 50000 else []
        right = [r for r in b if r not in set(a)][:3] if len(b) < 50000 else []
        return "VALUES", len(ours), f"{len(a)} vs {len(b)} rows\n  ours   {left}\n  theirs {right} {note}"
    return "ok", len(ours), note


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(contract.queries())
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            status, count, note = compare(spark, con, name, sf_dir)
        except Exception as problem:
            status, count, note = "FAILED", 0, "".join(traceback.format_exception_only(problem))[:1500]
        bad += status not in ("ok", "rows only")
        print(f"{status:10} {name:34} {count:7} rows {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
