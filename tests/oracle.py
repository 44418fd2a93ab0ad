"""Run a query and its SQL side by side and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}")
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value):
    return "null" if value is None else type(plain(value)).__name__


def compare(spark, con, run, sql, folder):
    """An empty text when equal, else what differs."""
    df = run(spark, folder)
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    if sql is None:
        return "", len(got)
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    if sorted(sql_names) != names:
        return f"columns {names} against {sorted(sql_names)}", len(got)
    order = [sql_names.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    a, b = Counter(got), Counter(want)
    if a == b:
        kinds = [{type(v).__name__ for v in col} - {"NoneType"} for col in zip(*got)]
        wants = [{type(v).__name__ for v in col} - {"NoneType"} for col in zip(*want)]
        for n, x, y in zip(names, kinds, wants):
            if x != y:
                return f"type of {n}: {x} against {y}", len(got)
        return "", len(got)
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"rows {len(got)}/{len(want)}; spark only {only_a}; sql only {only_b}", len(got)


def main():
    from markbook.session import build_session
    import __spark_entry__ as entry

    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    wanted = sys.argv[2:]
    spark = build_session(cores=os.environ.get("ORACLE_CORES", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem, rows = compare(spark, con, run, sqls.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in sqls else "rows")
        print(f"{mark:5s}{name:34s}{rows:8d}{time.time() - start:7.1f}s {problem[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
