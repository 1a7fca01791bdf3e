"""Order-insensitive comparison of a Spark result with DuckDB SQL over the same tables."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        path = f"{path}/*" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(int(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, float) or "float" in type(v).__name__ or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}" if float(v) != int(v) else str(int(v))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted("|".join(map(text, r)) for r in frame.itertuples(index=False, name=None))


def same(spark_df, con, sql):
    got, want = spark_df.toPandas(), con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert a == b, f"spark only {list(set(a) - set(b))[:3]}, oracle only {list(set(b) - set(a))[:3]}"
