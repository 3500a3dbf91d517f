"""Run a registered query in Spark and its SQL in DuckDB and compare names, counts, kinds and values."""

import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


NOTES: dict[str, list] = {}     # columns whose types differ in width only


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = Path(sf) / f"{t}.parquet"
        if p.exists():
            con.execute(f"create view {t} as select * from '{p}'")
    return con


def _kind(s: pd.Series) -> str:
    k = s.dtype.kind
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(k, "object")


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if _kind(df[c]) == "object":
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, (str, dict)) else str(v))
        if _kind(df[c]) == "time":
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), na_position="first", key=lambda s: s.astype(str) if _kind(s) == "object" else s).reset_index(drop=True)


def compare(spark, name, fn, sql, sf):
    """None when equal, else a short description; also the seconds Spark took."""
    t = time.time()
    got = fn(spark, sf).toPandas()
    took = time.time() - t
    if sql is None:
        return None, took, len(got)
    want = duck(sf).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}", took, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", took, len(got)
    NOTES[name] = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)]
    got, want = canonical(got), canonical(want)
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got.columns if _kind(got[c]) != _kind(want[c]) and not got[c].isna().any()]
    if kinds:
        return f"kinds {kinds}", took, len(got)
    for c in got.columns:
        g, w = got[c], want[c]
        same = (g == w) | (g.isna() & w.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} of {len(g)} differ, row {i}: {got.loc[i].to_dict()} != {want.loc[i].to_dict()}", took, len(got)
    return None, took, len(got)
