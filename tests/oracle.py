"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return (1, str(bool(v)))
        if hasattr(v, "isoformat"):
            return (2, pd.Timestamp(v).isoformat())
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            return (3, repr(float(v) + 0.0))
        return (4, str(v))

    columns = [[cell(v) for v in frame[n].astype(object).tolist()] for n in names]
    return sorted(zip(*columns)) if columns else []


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        names = sorted(spark_frame.columns)
        x, y = wrong[0]
        cells = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(wrong)} rows differ, first {cells[:4]}"
    return None


def kinds(frame_types) -> dict[str, str]:
    out = {}
    for name, t in frame_types:
        t = str(t).lower()
        if t.startswith("array"):
            t = "list"
        simple = {
            "bigint": "int64", "long": "int64", "int": "int32", "integer": "int32",
            "double": "double", "string": "text", "varchar": "text", "boolean": "bool",
            "date": "date", "timestamp": "ts", "timestamp_ntz": "ts",
        }
        out[name] = simple.get(t, t)
    return out


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from riskweft.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sql = oracle_sql()
    failed = []
    for name, run in queries().items():
        if args.names and not any(p in name for p in args.names):
            continue
        start = time.time()
        try:
            frame = run(spark, args.sf)
            got = frame.toPandas()
            took = time.time() - start
            if name in sql:
                cursor = con.execute(sql[name])
                types = [(d[0], d[1]) for d in cursor.description]
                want = cursor.fetchdf()
                problem = difference(got, want)
                a, b = kinds(frame.dtypes), kinds(types)
                odd = {n: (a[n], b.get(n)) for n in a if a[n] != b.get(n)}
                if odd:
                    problem = f"{problem or ''} types {odd}"
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # report and go on with the next query
            took = time.time() - start
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            got = []
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name:45s} {took:6.2f}s rows={len(got)} {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
