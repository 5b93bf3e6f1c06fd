"""Compare registered queries with their SQL: python tests/oracle.py <folder> [query ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _canonical(pdf: pd.DataFrame) -> list[tuple]:
    def cell(x: object) -> object:
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f":
            return f"{float(x):.9g}"
        return str(int(x)) if hasattr(x, "dtype") and x.dtype.kind in "iu" or isinstance(x, int) else str(x)

    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(cell(x) for x in row) for row in pdf.itertuples(index=False)), key=repr)


def differences(spark, con, folder: str, name: str, run, sql: str) -> str | None:  # noqa: ANN001
    got, want = run(spark, folder).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    a, b = _canonical(got), _canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}: {sorted(set(a) ^ set(b), key=repr)[:4]}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ: {str(wrong[:2])[:1500]}" if wrong else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from siftwell.session import build_session

    spark, folder = build_session("8"), sys.argv[1]
    con, sqls = connect(folder), oracle_sql()
    for name, run in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                out = differences(spark, con, folder, name, run, sqls[name]) or "ok"
            else:
                out = f"rows only: {run(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            out = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name:32} {time.time() - start:6.1f}s  {out}", flush=True)
