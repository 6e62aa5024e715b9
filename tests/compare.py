"""Side-by-side run of a registered query and its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def tidy(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    out = {}
    for c in pdf.columns:
        col = pdf[c]
        if col.dtype == object or str(col.dtype).startswith("str"):
            out[c] = col.map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else x)
        else:
            out[c] = pd.to_numeric(col).astype("float64")
    pdf = pd.DataFrame(out)
    return pdf.sort_values(list(pdf.columns), na_position="first", ignore_index=True)


def kinds(dtypes) -> dict:
    families = {
        "bigint": "long", "int": "int", "double": "double", "string": "text", "boolean": "bool",
        "BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "text", "BOOLEAN": "bool",
    }
    return {name: families.get(str(kind), str(kind)) for name, kind in dtypes}


def differences(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    relation = con.sql(sql)
    want_kinds = kinds(zip(relation.columns, relation.types, strict=True))
    have_kinds = kinds(spark_df.dtypes)
    if want_kinds != have_kinds:
        return f"columns: have {have_kinds}, want {want_kinds}"
    want, have = tidy(relation.df()), tidy(spark_df.toPandas())
    if len(want) != len(have):
        return f"rows: have {len(have)}, want {len(want)}"
    if not len(want):
        return "both sides are empty"
    for c in want.columns:
        w, h = want[c], have[c]
        same = (w == h) | (w.isna() & h.isna())
        if w.dtype == "float64":
            same &= (np.signbit(w) == np.signbit(h)) | w.isna()  # 0.0 and -0.0 hash apart
        if not same.all():
            first = int(np.argmin(same.to_numpy()))
            return f"{c}: {int((~same).sum())} values differ, first: have {have.loc[first].to_dict()}, want {want.loc[first].to_dict()}"
    return None
