"""Run registered queries beside their checking SQL and compare whole results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TOCSIN_DATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tocsin-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(((tuple(plain(r[i]) for i in order)) for r in rows), key=repr)


def compare(name, df, con, sql):
    got_c, got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    want_c, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only got {[r for r in got if r not in set(want)][:2]}; only want {[r for r in want if r not in set(got)][:2]}"
    for g, w in zip(got, want):
        for c, x, y in zip(got_c, g, w):
            same = x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and type(x) is not bool and abs(x - y) <= 1e-5 * max(1, abs(x)))
            if not same:
                return f"{c}: {x!r} != {y!r} in {dict(zip(got_c, g))} vs {dict(zip(got_c, w))}"
    return "" if got else "EMPTY"


def types_of(df, con, sql):
    """Integer width, float and text classes of both sides."""
    s = {f.name: f.dataType.simpleString() for f in df.schema}
    d = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    alike = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    return {c: (s[c], d.get(c)) for c in s if s[c] in alike and d.get(c) != alike[s[c]]}


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"{DATA}/sf{sf}"
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    qs, os_ = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(qs)
    names = [n for n in qs if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = qs[n](spark, sf_dir)
            if n in os_:
                msg = compare(n, df, con, os_[n])
                ty = types_of(df, con, os_[n])
                if ty:
                    msg = f"{msg} TYPES {ty}"
            else:
                msg = f"rows {df.count()} (no SQL)"
                if msg.startswith("rows 0 "):
                    msg = "EMPTY"
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {type(e).__name__} {str(e)[:700]}"
        if msg and "(no SQL)" not in msg:
            bad += 1
        print(f"{n:28s} {time.time() - t:6.1f}s {msg or 'ok'}", flush=True)
    print("bad", bad, "of", len(names))
