"""Run registered queries next to their SQL twins: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in rows], key=repr), [columns[i] for i in order]


def compare(spark, con, sf: str, fn, sql: str):
    df = fn(spark, sf)
    got, cols = as_rows(df.columns, df.collect())
    cur = con.execute(sql)
    want, wcols = as_rows([d[0] for d in cur.description], cur.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}", len(got)
    if got != want:
        extra = [g for g in got if g not in set(want)][:2]
        missing = [w for w in want if w not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}", len(got)
    return None, len(got)


def main():
    from pyspark.sql import SparkSession
    import __spark_entry__ as E

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem, n = compare(spark, con, sf, fn, sqls[name])
            else:
                problem, n = None, len(fn(spark, sf).collect())
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += problem is not None
        mark = "BAD" if problem else ("ok " if name in sqls else "run")
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {problem or ''}"[:2500], flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
