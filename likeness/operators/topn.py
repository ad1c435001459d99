"""The first rows of each group, whatever the size of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Below this Spark cuts every group to the limit on the map side by itself
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000
SALTS = 64


def first_per_group(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per group with their place, counted from 1, as ``rank``.

    A group is cut to ``n`` rows per task before it meets in one place: by Spark's group
    limit, or for large ``n`` by ranking a hash of the row first.
    """
    if n >= MAP_SIDE_LIMIT:
        # Maps have no hash; the other columns spread the rows well enough.
        hashed = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
        salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS))
        parts = Window.partitionBy(*keys, "salt").orderBy(*order)
        rows = rows.withColumn("salt", salt).withColumn("place", F.row_number().over(parts))
        rows = rows.filter(F.col("place") <= n).drop("salt", "place")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)
