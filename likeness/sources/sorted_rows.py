"""Rows stored in sorted runs with a table of fences, so that any page is one range.

A run is a folder of rows that lie between its first key and the next run's. The fences name
each run's first key, its rows and the rows before it. A page, however deep, is found in the
fences and read from the runs it lies in; a key is found in the same way.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.operators.ordering import page_facts

# Rows of a run; a page reads one run, or two where it lies across a fence.
RUN_ROWS = 100_000


class SortedRows:
    """Rows with (name, id) in that order, below ``path``. A folder is written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, rows: DataFrame, run_rows: int = RUN_ROWS) -> None:
        """Sort and store ``rows``; ids are unique, and null names come first. One row for each
        run comes to the driver."""
        runs = max(1, -(-rows.count() // run_rows))
        ranged = rows.repartitionByRange(runs, "name", "id").sortWithinPartitions("name", "id")
        ranged = ranged.withColumn("run", F.spark_partition_id())
        rows.limit(0).write.parquet(f"{self.path}/columns")  # for tables without rows
        ranged.write.partitionBy("run").parquet(f"{self.path}/rows")
        firsts = self._stored().groupBy("run").agg(
            F.min(F.struct("name", "id")).alias("first"), F.count("*").alias("rows")
        )
        found = sorted(firsts.collect(), key=lambda r: r["run"])
        before = [0, *accumulate(r["rows"] for r in found)]
        schema = f"run int, first {firsts.schema['first'].dataType.simpleString()}, rows long, start long"
        fences = [(r["run"], r["first"], r["rows"], s) for r, s in zip(found, before)]  # noqa: B905
        self.spark.createDataFrame(fences, schema).coalesce(1).write.parquet(f"{self.path}/fences")

    def fences(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/fences")

    def _stored(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        whole = T.StructType([*columns.fields, T.StructField("run", T.IntegerType())])
        return self.spark.read.schema(whole).parquet(f"{self.path}/rows")

    def _rows(self, runs: list[int]) -> DataFrame:
        return self._stored().filter(F.col("run").isin(runs)).drop("run")

    def page(self, offset: int, limit: int) -> DataFrame:
        """One page in order with the facts a pager needs, as ``ordering.page`` gives it."""
        end = F.col("start") + F.col("rows")
        met = self.fences().filter((end > offset) & (F.col("start") <= offset + limit))
        met = met.select("run", "start").orderBy("run").collect()  # those of one page
        skipped = offset - met[0]["start"] if met else 0
        rows = self._rows([r["run"] for r in met])
        asked = rows.orderBy("name", "id").offset(skipped).limit(limit + 1)
        return page_facts(asked, offset, limit)

    def page_from(self, name: str, limit: int, last_id=None) -> DataFrame:
        """The first ``limit`` rows from a name on, or behind the row with this name and id."""
        kind = self.fences().schema["first"].dataType["id"].dataType
        at = F.struct(F.lit(name).alias("name"), F.lit(last_id).cast(kind).alias("id"))
        # The run that holds the key, and as many behind it as the page may need.
        begun = self.fences().filter(F.col("first") <= at).agg(F.max("start")).first()[0] or 0
        end = F.col("start") + F.col("rows")
        near = self.fences().filter(end > begun).orderBy("run")
        runs, held = [], 0
        for row in near.select("run", "rows").toLocalIterator():
            runs.append(row["run"])
            held += row["rows"] if len(runs) > 1 else 0
            if held >= limit:
                break
        behind = F.col("name") > name
        same = F.col("name") == name
        behind |= same if last_id is None else same & (F.col("id") > F.lit(last_id))
        return self._rows(runs).filter(behind).orderBy("name", "id").limit(limit)
