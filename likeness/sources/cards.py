"""Reading bulk card files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.schema import BULK_INDEX, RAW_CARD
from likeness.sources.arrays import RANGE_BYTES, array_records


def read_cards(
    spark: SparkSession, path: str, layout: str = "array_lines", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Raw records from JSON; a broken file is an error.

    ``array_lines``: an array with one record per line, as bulk files are published; it
    is split over tasks. ``array_ranges``: a JSON array of any formatting, split over tasks by
    byte ranges; for plain files that pyarrow can open. ``array``: the same read by Spark, one
    task a file, from wherever Spark reads. ``lines``: JSON Lines.
    """
    if layout == "array":
        return spark.read.schema(RAW_CARD).json(path, multiLine=True, mode="FAILFAST")
    if layout == "lines":
        return spark.read.schema(RAW_CARD).json(path, mode="FAILFAST")
    if layout == "array_ranges":
        parsed = F.from_json("value", RAW_CARD, {"mode": "FAILFAST"}).alias("card")
        return array_records(spark, path, range_bytes).select(parsed).select("card.*")
    if layout == "array_lines":
        line = F.regexp_replace(F.trim("value"), r"^\[|,$|\]$", "")
        bare = spark.read.text(path).select(F.trim(line).alias("value")).filter("value <> ''")
        parsed = F.from_json("value", RAW_CARD, {"mode": "FAILFAST"}).alias("card")
        return bare.select(parsed).select("card.*")
    raise ValueError(f"unknown layout {layout!r}")


def store_cards(raw: DataFrame, path: str, partitions: int) -> None:
    """Write raw records as Parquet in even parts, ready for parallel reading."""
    raw.repartition(partitions).write.mode("overwrite").parquet(path)


def bulk_address(spark: SparkSession, path: str, kind: str) -> str:
    """The download address of the first entry of one kind in a bulk index file."""
    entries = spark.read.schema(BULK_INDEX).json(path, multiLine=True).select(
        F.posexplode("data").alias("place", "entry")
    )
    first = entries.filter(F.col("entry.type") == kind).orderBy("place").limit(1).collect()
    if not first or not first[0]["entry"]["download_uri"]:
        raise LookupError(f"no download address for {kind!r}")
    return first[0]["entry"]["download_uri"]
