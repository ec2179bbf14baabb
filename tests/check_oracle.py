"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py SF_DIR [name …]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "is_finite") or isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def compare(spark, con, fn, sql, sf):
    """None if the results agree, else a description of the difference."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return None if ours else "no rows", len(ours)
    con.execute(sql)
    names = [d[0] for d in con.description]
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}", len(ours)
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(_norm(r[i]) for i in order) for r in con.fetchall())
    if ours == theirs:
        return None, len(ours)
    diff = [x for x in zip(ours, theirs) if x[0] != x[1]][:2]
    return f"{len(ours)} / {len(theirs)} rows; {diff}", len(ours)


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main(sf, names):
    from edgeloom.plans import ORACLES, QUERIES
    from edgeloom.session import local_session

    spark = local_session()
    con = connect(sf)
    bad = 0
    for name in names or QUERIES:
        t = time.time()
        try:
            error, n = compare(spark, con, QUERIES[name], ORACLES.get(name), sf)
        except Exception as e:  # report and go on with the next query
            error, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        mark = ("ok  " if name in ORACLES else "rows") if error is None else "FAIL"
        bad += error is not None
        print(f"{mark} {name} {n} rows {time.time() - t:.1f}s {error or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
