import math

import duckdb
import pandas as pd

from websift.sources.tables import TABLES


def norm(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(norm(r[c]) for c in cols) for _, r in pdf[cols].iterrows()), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
