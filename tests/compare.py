"""Compare registered queries with their SQL: python tests/compare.py [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.append("/opt/oracle")

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def oracle(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def compare(spark, con, sf_dir, name, run, sql):
    """None when rows, names and types agree, else what differs."""
    df = run(spark, sf_dir)
    got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    for field in df.schema.fields:
        if KINDS[field.dataType.simpleString()] != types[field.name]:
            return f"{field.name}: {field.dataType.simpleString()} against {types[field.name]}"
    want = as_rows(relation.columns, relation.fetchall())
    if got != want:
        only_got, only_want = set(got) - set(want), set(want) - set(got)
        sample = [sorted(only_got)[:2], sorted(only_want)[:2]]
        return f"{len(got)} rows against {len(want)}; only here {len(only_got)}: {sample}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    chosen = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, sqls, bad = session(), oracle(sf_dir), oracle_sql(), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, run in queries().items():
        if chosen and not any(c in name for c in chosen):
            continue
        start = time.time()
        try:
            wrong = compare(spark, con, sf_dir, name, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += wrong is not None
        print(f"{time.time() - start:6.1f}s {name}: {wrong or 'ok'}"[:2500], flush=True)
    print(f"{bad} wrong")


if __name__ == "__main__":
    main()
