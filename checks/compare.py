"""Side-by-side run of the registered queries and their SQL.

``python -m checks.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[str | None, int]:
    """What differs (None: nothing) and the number of Spark rows."""
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    columns, ours = _rows(df.columns, got)
    if name not in ORACLES:
        return None, len(got)
    answer = con.execute(ORACLES[name])
    expected_columns, theirs = _rows([d[0] for d in answer.description], answer.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}", len(got)
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        sample = f"ours {list(extra)[:2]} theirs {list(missing)[:2]}"
        return f"{sum(extra.values())} extra, {sum(missing.values())} missing of {len(got)}: {columns}\n  {sample}", len(got)
    return None, len(got)


def main() -> int:
    from stallwise.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, rows = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {rows:7d} rows {time.time() - start:6.2f}s", problem or "", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
