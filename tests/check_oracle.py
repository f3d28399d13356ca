"""Run registered queries next to their SQL twins and report differences.

Usage: python tests/check_oracle.py [sf] [name-or-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _key(row):
    return tuple((x is not None, type(x).__name__ if isinstance(x, (str, bool)) else "n", x)
                 if x is not None else (False, "", 0) for x in row)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=_key)


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    sc, sr = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    dc, dr = normalise([d[0] for d in rel.description], rel.fetchall())
    if sc != dc:
        return f"columns {sc} vs {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} vs {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, e.g. {bad[0]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = make_session()
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sql:
                problem = compare(df, con, sql[name])
                n = "ok"
            else:
                problem, n = None, f"rows={df.count()}"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        took = time.time() - began
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {problem or n}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
