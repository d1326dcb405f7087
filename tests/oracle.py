"""Run queries beside their SQL: python tests/oracle.py DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, map(normal, v))) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, query, sql):
    import duckdb

    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    return mine, theirs


def main(sf_dir, only):
    import __spark_entry__ as e
    from traceloom.session import local_session

    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.ui.showConsoleProgress", "false")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = e.oracle_sql(), 0
    for name, q in e.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            if name not in sqls:
                print(f"{name}: {q(spark, sf_dir).count()} rows, no SQL, {time.time() - t:.1f} s", flush=True)
                continue
            mine, theirs = compare(spark, sf_dir, name, q, sqls[name])
        except Exception as x:
            bad += 1
            print(f"{name}: ERROR {str(x)[:600]}", flush=True)
            continue
        same = mine == theirs
        bad += not same
        print(f"{name}: {'same' if same else 'DIFFERS'} {len(mine[1])} / {len(theirs[1])} rows, {time.time() - t:.1f} s", flush=True)
        if not same:
            a, b = set(mine[1]), set(theirs[1])
            print("  columns", mine[0], theirs[0], "\n  only Spark", sorted(a - b)[:4], "\n  only SQL", sorted(b - a)[:4])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
