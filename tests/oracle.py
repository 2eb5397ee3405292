"""Compare a registered query with its SQL twin on one folder of tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if hasattr(v, "asDict"):
        return {k: _norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([_norm(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """Returns (ok, message)."""
    df = fn(spark, folder)
    got, cols = [tuple(r) for r in df.collect()], df.columns
    if sql is None:
        return True, f"{len(got)} rows, no twin"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(want_cols):
        return False, f"columns {sorted(cols)} != {sorted(want_cols)}"
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}
    duck_types = {d[0]: kinds.get(str(d[1]), str(d[1])) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    types = {k: (v, duck_types[k]) for k, v in df.dtypes if duck_types[k] != v and "[" not in duck_types[k]}
    a, b = _rows(got, cols), _rows(want, want_cols)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{len(a)} vs {len(b)} rows; first differences {diff} types {types}"
    return True, f"{len(a)} rows" + (f" TYPES {types}" if types else "") + ("" if a else " EMPTY")


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from touchline.session import build_session

    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session("check", os.environ.get("MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                             "spark.ui.showConsoleProgress": "false", **({"spark.driver.memory": os.environ["MEM"]} if "MEM" in os.environ else {})})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    wanted = sys.argv[1:]
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, fn, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} {time.time() - start:6.1f}s {note}", flush=True)
