"""Run registered queries beside their SQL twins: python check.py [sf_dir] [name-prefix ...]"""

import math
import sys
import tempfile
import time

import duckdb

from tapewell.plans import catalog
from tapewell.session import build_session, job

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    want = sys.argv[2:]
    catalog.load()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
                                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            with job(spark) as written:
                df = fn(spark, sf)
                cols = sorted(df.columns)
                got = sorted((tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        took = time.time() - t0
        if name not in catalog.ORACLES:
            print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
            continue
        try:
            rel = con.execute(catalog.ORACLES[name])
            names = [d[0] for d in rel.description]
            idx = [names.index(c) for c in cols]
            exp = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
        except Exception as e:
            bad += 1
            print(f"ORACLE {name}: {str(e)[:1500]}", flush=True)
            continue
        if got == exp:
            print(f"ok    {name} {len(got)} {took:.1f}s, {len(written)} step tables", flush=True)
            if not got:
                print("   EMPTY", name)
            dead = [c for i, c in enumerate(cols) if got and len({r[i] for r in got}) == 1 and len(got) > 3]
            if dead:
                print("   constant:", {c: got[0][cols.index(c)] for c in dead})
        else:
            bad += 1
            g, e = set(got), set(exp)
            a, b = sorted(g - e, key=repr), sorted(e - g, key=repr)
            print(f"DIFF  {name} spark={len(got)} sql={len(exp)} only_spark={len(a)} only_sql={len(b)}\n  {cols}", flush=True)
            for x in a[:3]:
                print("   spark", x)
            for x in b[:3]:
                print("   sql  ", x)
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
