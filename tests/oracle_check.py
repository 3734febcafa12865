"""Run registered queries next to their SQL and compare rows. Usage: oracle_check.py [--sf 0.01] [--limit ROWS] [names...]

``--limit`` sets the group size above which groups are sliced, to exercise that path on small data."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v if isinstance(v, int) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """None when equal, else a short reason."""
    df = fn(spark, folder)
    mine = df.toArrow()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = [mine.column(i).to_pylist() for i in range(mine.num_columns)]
    a = rows_of(df.columns, list(zip(*cols)) if cols else [])
    b = rows_of(names, res.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, cols {sorted(names)}, first {bad[0]}"
    return None if a else "EMPTY"


def main():
    from laplens.session import build_session

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    limit = None
    if args[:1] == ["--limit"]:
        limit, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    if limit:
        spark.conf.set("laplens.groupLimit", limit)
    con = connect(folder)
    qs, os_ = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) or fn.__module__.endswith("." + a)
                            for a in args):
            continue
        t0 = time.time()
        try:
            if name in os_:
                why = compare(spark, con, folder, fn, os_[name])
            else:
                n = len(fn(spark, folder).collect())
                why = None if n else "EMPTY"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(why)
        print(f"{'ok  ' if not why else 'FAIL'} {name} {time.time() - t0:.1f}s {why or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
