"""Compare registered queries with their SQL: python check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

from casebook.queries import ORACLES, QUERIES, load_all
from casebook.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    load_all()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, root)
            cols = sorted(df.columns)
            rows = [tuple(row[c] for c in cols) for row in df.collect()]
            el = time.time() - t0
            if name not in ORACLES:
                print(f"ROWS {name} {len(rows)} {el:.1f}s  e.g. {rows[0] if rows else None}", flush=True)
                continue
            t1 = time.time()
            rel = con.execute(ORACLES[name])
            ocols = [d[0] for d in rel.description]
            orows = rel.fetchall()
            osec = time.time() - t1
            if sorted(ocols) != cols:
                print(f"FAIL {name} columns {cols} vs {sorted(ocols)}")
                bad += 1
                continue
            idx = [ocols.index(c) for c in cols]
            a = sorted(tuple(norm(v) for v in row) for row in rows)
            b = sorted(tuple(norm(row[i]) for i in idx) for row in orows)
            otypes = dict(zip(ocols, [str(d[1]) for d in rel.description]))
            stypes = dict(df.dtypes)
            if a == b:
                print(f"ok   {name} {len(a)} rows {el:.1f}s (sql {osec:.1f}s)", flush=True)
            else:
                bad += 1
                da = [x for x in a if x not in set(b)][:3]
                db = [x for x in b if x not in set(a)][:3]
                print(f"FAIL {name} rows {len(a)} vs {len(b)}\n   cols  {cols}\n   spark {da}\n   sql   {db}")
            want = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
            diff = {c: (stypes[c], otypes[c]) for c in cols if want.get(otypes[c], otypes[c]) != stypes[c]}
            if diff:
                print(f"     types differ in {name}: {diff}")
        except Exception as e:
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    print("bad:", bad)


if __name__ == "__main__":
    main()
