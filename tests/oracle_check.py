"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()
WIDTHS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a DuckDB result; empty when equal."""
    problems = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    want_rows = cur.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    for c, t in spark_df.dtypes:
        if WIDTHS.get(t) != types[c]:
            problems.append(f"type of {c}: {t} vs {types[c]}")
    order = sorted(names)
    got = sorted((tuple(_norm(r[c]) for c in order) for r in spark_df.collect()), key=_key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in want_rows), key=_key)
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ, first {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}")
    if not got:
        problems.append("note: no rows")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from pagemill.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    wanted = [a for a in args if "/" not in a]
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracle:
                problems = compare(df, con, oracle[name])
            else:
                problems = [] if df.count() else ["note: no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        took = time.time() - start
        bad += bool(problems)
        mark = "ok " if not problems else "BAD"
        print(f"{mark} {name} {'D' if name in oracle else 'R'} {took:.1f}s {'; '.join(problems)}", flush=True)
    print(f"{bad} with problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
