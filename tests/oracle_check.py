"""Compare registered queries with their SQL on a folder of tables: ``python -m tests.oracle_check [folder] [names...]``."""

import sys
import time

import duckdb

import __spark_entry__ as entry
from framesift.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def normal(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, db, folder, name):
    """None if equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = normal([tuple(r) for r in df.select(*names).collect()])
    rel = db.sql(entry.oracle_sql()[name])
    if sorted(rel.columns) != names:
        return f"columns {names} against {sorted(rel.columns)}"
    order = [rel.columns.index(n) for n in names]
    want = normal([tuple(r[i] for i in order) for r in rel.fetchall()])
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{names}: {g} against {w}"
    return None if got else "no rows"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        if name in entry.oracle_sql():
            try:
                result = compare(spark, db, folder, name) or "ok"
            except Exception as e:
                result = f"error {str(e)[:600]}"
        else:
            result = f"no SQL, {entry.queries()[name](spark, folder).count()} rows"
        print(f"{name:32s} {time.time() - start:6.2f}s  {result}", flush=True)
