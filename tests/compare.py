"""Runs registered queries against their DuckDB statement, as the correctness gate does.

``python -m tests.compare [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(df, con, sql):
    """Empty text when both results hold the same rows."""
    names, got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    wnames, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != wnames:
        return f"columns {set(names) ^ set(wnames)}"
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cells = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
        return f"{len(bad)} of {len(got)} rows differ, first: {cells[:4]}"
    kinds = {n: {type(r[i]) for r in got + want if r[i] is not None} for i, n in enumerate(names)}
    mixed = {n: k for n, k in kinds.items() if len(k) > 1}
    return f"types {mixed}" if mixed else ""


def main(argv):
    from rentalytics.runtime import local_session
    from __spark_entry__ import oracle_sql, queries

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), oracle_sql()
    failed = 0
    for name, query in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                note = differences(query(spark, sf_dir), con, sql[name])
            else:
                note = f"(no SQL) rows {query(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__} {str(e)[:600]}"
        ok = not note or note.startswith("(no SQL)")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {note}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
