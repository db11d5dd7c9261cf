"""Run registered queries and their DuckDB twins side by side (like the driver).

usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: OK / MISMATCH with the reason.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return repr(float(v))
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (int,)):
        return repr(int(v))
    return str(v)


def _py(x):
    import numpy as np
    if isinstance(x, np.generic):
        return x.item()
    return x


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(canon(_py(x)) for x in rec))
    return cols, sorted(out)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not a.startswith("/")]
    from corpuslab.session import get_spark
    import __spark_entry__ as E
    spark = get_spark()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for key in sorted(qs):
        if only and key not in only:
            continue
        t0 = time.time()
        try:
            sp = qs[key](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{key:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if key not in os_:
            print(f"{key:28s} rows-only  rows={len(sp)} cols={list(sp.columns)} {ts:.1f}s")
            continue
        try:
            dd = con.execute(os_[key]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{key:28s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dd)
        if c1 != c2:
            print(f"{key:28s} MISMATCH cols spark={c1} duck={c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"{key:28s} MISMATCH rows spark={len(r1)} duck={len(r2)}")
            bad += 1
        elif r1 != r2:
            diff = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
            print(f"{key:28s} MISMATCH values {diff}")
            bad += 1
        else:
            print(f"{key:28s} OK rows={len(r1)} {ts:.1f}s")
    print(f"bad={bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
