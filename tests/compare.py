"""Holds registered queries against their SQL in DuckDB: python tests/compare.py [sf_dir] [name...]."""

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def difference(df, con, sql):
    """None, or what differs."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} and {sorted(rel.columns)}"
    ours = Counter(tuple(value(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    theirs = Counter(tuple(value(x) for x in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    kinds = [k for k in df.select(*[f"`{c}`" for c in cols]).dtypes]
    other = [str(t) for t in con.sql(f"SELECT {names} FROM ({sql})").types]
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    wrong = [(c, a, b) for (c, a), b in zip(kinds, other) if same.get(a, b) != b]
    if ours == theirs:
        return f"types {wrong}" if wrong else None
    a, b = ours - theirs, theirs - ours
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(a)[:2]}; only theirs {list(b)[:2]}; types {wrong}"


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master(f"local[{os.environ.get('N', '4')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles, con, bad = entry.queries(), entry.oracle_sql(), connect(sf_dir), 0
    for name in sys.argv[2:] or queries:
        if name.startswith(("op", "pipeline")) and not sys.argv[2:]:
            continue
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            found = difference(df, con, oracles[name]) if name in oracles else f"no SQL; {df.count()} rows"
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:500]}"
        bad += found is not None and not found.startswith("no SQL")
        if found:
            print(name, f"{time.time() - began:.1f}s", found[:900], flush=True)
    print(len(queries), "queries,", bad, "bad")


if __name__ == "__main__":
    main()
