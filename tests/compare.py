"""Run queries in Spark and their SQL in DuckDB and compare: python -m tests.compare DIR [names]."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def rows_of(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(rel.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    return (f"{len(bad)} rows differ, first {bad[0]}" if bad else None), len(got)


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(sf_dir)
    qs, oracle = queries(), oracle_sql()
    fails = 0
    for name in names or list(qs):
        t = time.time()
        try:
            if name in oracle:
                diff, n = compare(spark, con, qs[name], oracle[name], sf_dir)
            else:
                n = len(qs[name](spark, sf_dir).collect())
                diff = None
            status = "ok" if diff is None else "DIFF"
        except Exception as e:  # noqa: BLE001
            status, diff, n = "ERROR", str(e)[:1500], -1
        fails += status != "ok"
        flag = "" if name in oracle else " (no sql)"
        print(f"{status:5} {name}{flag} rows={n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("failed:", fails)


if __name__ == "__main__":
    main()
