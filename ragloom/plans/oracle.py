"""Side-by-side check of registered queries against their DuckDB oracles."""

from __future__ import annotations

import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(df, con, sql: str):
    """(ok, spark_rows, duck_rows, detail)."""
    rows = df.collect()
    cols = sorted(df.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=repr)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    if sorted(dcols) != cols:
        return False, len(rows), None, f"columns spark={cols} duck={sorted(dcols)}"
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    if srows == drows:
        return True, len(srows), len(drows), ""
    sset, dset = set(srows), set(drows)
    detail = ("spark-only: " + repr(list(sset - dset)[:2])[:600] + "\nduck-only: "
              + repr(list(dset - sset)[:2])[:600])
    return False, len(srows), len(drows), detail
