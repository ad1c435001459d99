"""Means of vectors per query, as sums of a bounded number of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.functions.vectors import l2_normalize

# Positions summed in one row. Below the 100 fields up to which Spark compiles a stage.
CHUNK = 64


def weighted_mean(
    rows: DataFrame, key: str, dim: int, weight: Column | None = None
) -> DataFrame:
    """(key, vector): the weighted mean of ``vector`` per key, not normalised.

    A vector becomes dim/64 rows with 64 sums each, so the aggregation is partial on
    the map side, however many rows a key has. Vectors of another length are an error.
    """
    weight = (F.lit(1) if weight is None else weight).cast("double")
    chunks = -(-dim // CHUNK)
    checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(
        F.raise_error(F.lit(f"a vector does not have {dim} dimensions"))
    )
    cut = rows.select(
        key,
        weight.alias("w"),
        checked.alias("vector"),
        (F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))) if chunks > 1 else F.lit(0)).alias("c"),
    )

    width = min(CHUNK, dim)
    value = "CAST(get(vector, c * {c} + {i}) AS DOUBLE) * w"
    sums = cut.groupBy(key, "c").agg(
        F.sum("w").alias("w"),
        *[F.expr(f"sum({value.format(c=CHUNK, i=i)}) AS s{i}") for i in range(width)],
    )
    part = F.expr(f"array({', '.join(f's{i} / w' for i in range(width))})")
    means = sums.select(key, "c", part.alias("part"))
    if chunks == 1:
        return means.select(key, F.col("part").alias("vector"))
    # At most dim/64 parts per key.
    parts = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("c", "part"))).alias("p"))
    joined = F.flatten(F.transform("p", lambda x: x["part"]))
    return parts.select(key, F.slice(joined, 1, dim).alias("vector"))


def centroids(
    rows: DataFrame, key: str, dim: int, weight: Column | None = None
) -> DataFrame:
    """(key, vector): the mean per key at unit length; a zero mean stays zero."""
    means = weighted_mean(rows, key, dim, weight)
    return means.select(key, l2_normalize(F.col("vector")).alias("vector"))
