"""Compare a query with its SQL on one scale: same columns, same rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("events", "documents", "embeddings", "pages", "labels", "conversations", "benchmark")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "null"
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(v) < 5e-7 else f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    out = df[sorted(df.columns)]
    return pd.DataFrame({c: [cell(v) for v in out[c].astype(object)] for c in out}).sort_values(list(out.columns)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    a, b = _canonical(spark_df), _canonical(sql_df)
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{bad.sum()} rows differ, e.g. {a[bad].head(2).to_dict('records')} / {b[bad].head(2).to_dict('records')}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from pressroom.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    only = sys.argv[2:]
    spark, con = build_session(**{"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": "8"}), connect(sf)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            t = time.time()
            got = query(spark, sf).toPandas()
            t1 = time.time()
            if name not in sql:
                print(f"{name}: {len(got)} rows, no SQL, {t1 - t:.1f}s", flush=True)
                continue
            want = con.execute(sql[name]).df()
            print(f"{name}: {difference(got, want) or 'ok'} ({len(got)} rows, spark {t1 - t:.1f}s, sql {time.time() - t1:.1f}s)", flush=True)
        except Exception as e:  # report and go on with the next query
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
