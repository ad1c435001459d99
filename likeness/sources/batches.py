"""Batch files: documents ``{"objects": [{class, id, properties, vector}, ...]}``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.operators.ordering import with_position
from likeness.schema import BATCH_FILE

OBJECT_CLASS = "Card"
BATCH_SIZE = 1000


def batch_objects(cards: DataFrame, vectors: DataFrame) -> DataFrame:
    """One object per card with a vector, from the flat card table and (id, vector)."""
    joined = cards.join(vectors.select("id", "vector"), F.col("scryfall_id") == F.col("id"))
    return joined.select(
        F.lit(OBJECT_CLASS).alias("class"),
        "id",
        F.struct(*[F.col(name) for name in cards.columns]).alias("properties"),
        "vector",
    )


def write_batches(objects: DataFrame, path: str, batch_size: int = BATCH_SIZE) -> None:
    """Documents of at most ``batch_size`` objects in id order, one per line; fields
    that are NULL are left out."""
    number = F.floor(F.col("position") / batch_size)
    documents = (
        with_position(objects, "id")
        .groupBy(number.alias("batch"))
        .agg(F.collect_list(F.struct("position", "class", "id", "properties", "vector")).alias("o"))
    )
    in_order = F.array_sort("o", lambda a, b: (a["position"] - b["position"]).cast("int"))
    fields = ["class", "id", "properties", "vector"]
    objects = F.transform(in_order, lambda o: F.struct(*[o[f].alias(f) for f in fields]))
    documents = documents.select(objects.alias("objects"))
    documents.write.option("ignoreNullFields", "true").json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The objects of batch files, one row each: (class, id, properties, vector)."""
    documents = spark.read.schema(BATCH_FILE).json(path, mode="FAILFAST")
    return documents.select(F.explode("objects").alias("o")).select("o.*")


def count_objects(spark: SparkSession, path: str) -> int:
    """A broken file is an error, as it is when it is read."""
    return spark.read.schema(BATCH_FILE).json(path, mode="FAILFAST").select(
        F.coalesce(F.sum(F.size("objects")), F.lit(0))
    ).head()[0]
