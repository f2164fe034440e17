"""Run registered queries next to their SQL twins in DuckDB and compare the results.

    python tests/compare.py [sf dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else f"{v:.9g}")
        elif pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    kinds = {c: (spark_df[c].dtype.kind, sql_df[c].dtype.kind) for c in spark_df if spark_df[c].dtype.kind != sql_df[c].dtype.kind}
    a, b = normal(spark_df), normal(sql_df)
    bad = (a != b).any(axis=1)
    if bad.any():
        i = bad.idxmax()
        cols = [c for c in a if a[c][i] != b[c][i]]
        return f"{bad.sum()} of {len(a)} rows; first, columns {cols}: {dict(a.loc[i])} / {dict(b.loc[i])}"
    return f"types {kinds}" if kinds and len(a) else None


def main() -> int:
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from foliant.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    extra = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("compare", **{"spark.master": "local[8]", **extra})
    spark.sparkContext.setLogLevel("OFF")
    queries, twins, con, failed = entry.queries(), entry.oracle_sql(), connect(sf_dir), 0
    for name in args or queries:
        t = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - t
            if name not in twins:
                print(f"rows {name} {len(got)} {took:.1f}s", flush=True)
                continue
            t = time.time()
            diff = differences(got, con.execute(twins[name]).df())
            print(f"{'ok  ' if diff is None else 'DIFF'} {name} {len(got)} {took:.1f}s sql {time.time() - t:.1f}s {diff or ''}"[:900], flush=True)
            failed += diff is not None
        except Exception as exc:  # noqa: BLE001 - a report, every query gets its line
            failed += 1
            print(f"FAIL {name} {type(exc).__name__} {str(exc)[:600]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
