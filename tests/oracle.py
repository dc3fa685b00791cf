"""Run queries and their SQL side by side: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import glob
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True) if len(df) else df


def differences(got: pd.DataFrame, expect: pd.DataFrame) -> list[str]:
    out = []
    if sorted(got.columns) != sorted(expect.columns):
        return [f"columns {sorted(got.columns)} != {sorted(expect.columns)}"]
    if len(got) != len(expect):
        return [f"rows {len(got)} != {len(expect)}"]
    got, expect = normal(got), normal(expect)
    for c in got.columns:
        if got[c].dtype != expect[c].dtype and not (got[c].dtype.kind == "O" or expect[c].dtype.kind == "O"):
            out.append(f"{c}: type {got[c].dtype} != {expect[c].dtype}")
        a, b = got[c].astype(object), expect[c].astype(object)
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            out.append(f"{c}: {bad.sum()} values differ, e.g. {a[i]!r} != {b[i]!r}")
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        start = time.time()
        try:
            got = queries()[n](spark, sf_dir).toPandas()
            spent = time.time() - start
            if n in oracle_sql():
                t = time.time()
                found = differences(got, con.execute(oracle_sql()[n]).df())
                note = "ok" if not found else "DIFFERS " + "; ".join(found)
                note += f" (duckdb {time.time() - t:.1f}s)"
            else:
                note = "rows only"
        except Exception as e:  # noqa: BLE001
            spent, note = time.time() - start, f"FAILED {type(e).__name__}: {str(e)[:600]}"
            got = []
        bad += "DIFFERS" in note or "FAILED" in note
        print(f"{n:32s} {len(got):8d} rows {spent:6.1f}s  {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
