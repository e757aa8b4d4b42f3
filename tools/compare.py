"""Run queries next to their SQL and report differences: compare.py SF [names]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldscan.session import build_session  # noqa: E402
from workload.queries import ORACLE, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def engine(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLE:
        return True, f"{len(got[1])} rows, {took:.1f}s, rows only"
    res = con.execute(ORACLE[name])
    want = rows_of([d[0] for d in res.description], res.fetchall())
    if got == want:
        return True, f"{len(got[1])} rows, {took:.1f}s"
    extra, missing = sorted(set(got[1]) - set(want[1])), sorted(set(want[1]) - set(got[1]))
    return False, (
        f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}\n   extra {len(extra)}: {extra[:3]}\n   missing {len(missing)}: {missing[:3]}"
    )


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = build_session("local[8]", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("OFF")
    con = engine(sf)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            ok, text = compare(spark, con, sf, name)
        except Exception as e:  # report and go on
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, text, flush=True)
    print("failures:", bad)
