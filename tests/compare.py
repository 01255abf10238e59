"""Run registered queries and their SQL checks side by side.

    python tests/compare.py SF_DIR [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir):
    from workload.fixture import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "~" if pd.isna(v) else f"{v:.9g}")
        else:
            df[c] = df[c].map(lambda v: "~" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(spark, con, sf_dir, name, run, sql):
    """Text describing the first difference; None when equal."""
    left = run(spark, sf_dir).toPandas()
    if sql is None:
        return None if len(left) else "no rows"
    right = con.execute(sql).to_arrow_table().to_pandas()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if not len(left):
        return "both empty"
    a, b = canonical(left), canonical(right)
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"{bad.sum()} of {len(a)} differ in {c}: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main():
    import __spark_entry__ as entry
    from bomatlas.session import build_session

    spark = build_session(
        "compare", "local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
