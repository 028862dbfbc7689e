"""Compare named queries with their SQL on DuckDB; run as ``python -m tests.oracle [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from geofold.plans import catalog
from geofold.plans.views import TABLES
from geofold.session import build_session


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp", "SMALLINT": "smallint", "HUGEINT": "hugeint", "FLOAT": "float"}


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    df = catalog.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    kinds = {r[0]: KINDS.get(r[1], r[1]) for r in con.execute(f"describe {sql}").fetchall()}
    types = dict(df.dtypes)
    odd = {c: (types[c], kinds[c]) for c in cols if types[c].replace("_ntz", "") != kinds[c]}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "both empty"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(want)} rows differ, columns {sorted(cols)}, first {bad[0][0]} != {bad[0][1]}"
    return None


def main(argv):
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    catalog.load()
    names = []
    for a in argv or list(catalog.QUERIES):
        names += [a] if a in catalog.QUERIES else [n for n, f in catalog.QUERIES.items() if f.__module__.endswith("." + a)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            why = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on
            why = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - t
        if why:
            failed += 1
            print(f"FAIL {n} ({took:.1f}s): {why}", flush=True)
        elif took > 4:
            print(f"slow {n} ({took:.1f}s)", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
