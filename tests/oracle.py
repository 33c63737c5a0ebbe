"""Side-by-side comparison of registered queries with their SQL twins in DuckDB."""

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v if v is None else str(v)


def kind(v):
    return "num" if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        ([tuple(cell(r[i]) for i in order) for r in rows]),
        key=lambda r: tuple((c is None, c or "") for c in r),
    )


def compare(spark, con, root, name, queries, oracle):
    """(ok, message)"""
    df = queries[name](spark, root)
    got = df.collect()
    rel = con.sql(oracle[name])
    want, columns = rel.fetchall(), rel.columns
    if sorted(df.columns) != sorted(columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows\n  spark  {str(only_a)[:900]}\n  duckdb {str(only_b)[:900]}"
    types = dict(df.dtypes)
    duck = dict(zip(columns, map(str, rel.types)))
    odd = {c: (types[c], duck[c]) for c in types if not _same_type(types[c], duck[c])}
    return True, f"{len(a)} rows" + (f" types differ: {odd}" if odd else "")


def _same_type(spark_type, duck_type):
    pairs = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
    }
    return pairs.get(spark_type, spark_type) == duck_type


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from velum.plans.registry import ORACLE, QUERIES
    from velum.session import build_session

    root = "/root/testdata/sf0.01"
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    for name in names:
        start = time.time()
        try:
            if name in ORACLE:
                ok, message = compare(spark, con, root, name, QUERIES, ORACLE)
            else:
                ok, message = True, f"{QUERIES[name](spark, root).count()} rows, no twin"
        except Exception as e:
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", message, flush=True)
