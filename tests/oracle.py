"""Compares registered queries with their SQL on one scale of the given tables."""

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return repr(v)


def compare(con, sql, df):
    """Empty string when equal, else what differs."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    theirs = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    kinds = {"long": "int", "integer": "int", "double": "float", "string": "str", "boolean": "bool"}
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    ours = [tuple(_cell(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    sample = next((r for r in theirs if all(r[i] is not None for i in at)), None)
    if sample is not None:
        bad = [(c, types[c], type(sample[i]).__name__) for c, i in zip(order, at) if kinds.get(types[c]) != type(sample[i]).__name__]
        if bad:
            return f"types {bad}"
    other = [tuple(_cell(r[i]) for i in at) for r in theirs]
    if sorted(ours) == sorted(other):
        return ""
    a, b = sorted(set(ours) - set(other)), sorted(set(other) - set(ours))
    return f"rows {len(ours)} != {len(other)}; {order}\n   only here {a[:3]}\n   only sql  {b[:3]}"


def run(names=None, sf="/root/testdata/sf0.01"):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from orgsift.session import local_session
    spark = local_session("oracle", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                diff = compare(con, sqls[name], df)
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                diff, n = "", df.count()
            status = "ok " if not diff else "DIFF"
        except Exception as e:  # noqa: BLE001
            status, diff, n = "ERR", str(e)[:1500], 0
        bad += bool(diff)
        print(f"{status} {name} rows={n} {time.time() - t:.1f}s {'' if name in sqls else '(no sql)'} {diff}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("/")]
    folder = [a for a in sys.argv[1:] if a.startswith("/")]
    sys.exit(run(args, *(folder[:1])) > 0)
