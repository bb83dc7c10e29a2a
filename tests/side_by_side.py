"""Run registered queries and their SQL on the same files and compare all values.

    python tests/side_by_side.py <sf_dir> [name prefix ...]
"""

from __future__ import annotations

import collections
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return (sorted(names),
            collections.Counter(tuple(_plain(row[i]) for i in order) for row in rows))


def compare(spark, connection, name: str, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    mine = _bag(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    theirs = _bag([d[0] for d in found.description], found.fetchall())
    n = sum(mine[1].values())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        return False, (f"{n} rows / {sum(theirs[1].values())}; only here "
                       f"{list((mine[1] - theirs[1]).items())[:2]}; only there "
                       f"{list((theirs[1] - mine[1]).items())[:2]}")
    return True, f"{n} rows"


def main() -> None:
    from pyspark.sql import SparkSession

    from folioscope.workload.oracles import oracles
    from folioscope.workload.queries import queries

    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    connection, sqls = connect(sf_dir), oracles()
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            same, note = compare(spark, connection, name, query, sqls[name], sf_dir)
        except Exception as error:
            same, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if same else 'DIFF'} {name:30s} {time.time() - start:6.1f}s {note}",
              flush=True)


if __name__ == "__main__":
    main()
