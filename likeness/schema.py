"""Table shapes, declared once, and the checks that hold data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TEXT = T.StringType()
_TEXTS = T.ArrayType(T.StringType())
_URIS = T.MapType(T.StringType(), T.StringType())

FACE = T.StructType(
    [
        T.StructField("type_line", _TEXT),
        T.StructField("oracle_text", _TEXT),
        T.StructField("image_uris", _URIS),
    ]
)

# One record of the bulk file; a missing key reads as NULL.
RAW_CARD = T.StructType(
    [
        T.StructField("id", _TEXT),
        T.StructField("name", _TEXT),
        T.StructField("mana_cost", _TEXT),
        T.StructField("cmc", T.DoubleType()),
        T.StructField("type_line", _TEXT),
        T.StructField("oracle_text", _TEXT),
        T.StructField("power", _TEXT),
        T.StructField("toughness", _TEXT),
        T.StructField("colors", _TEXTS),
        T.StructField("color_identity", _TEXTS),
        T.StructField("keywords", _TEXTS),
        T.StructField("edhrec_rank", T.IntegerType()),
        T.StructField("set", _TEXT),
        T.StructField("collector_number", _TEXT),
        T.StructField("rarity", _TEXT),
        T.StructField("layout", _TEXT),
        T.StructField("image_uris", _URIS),
        T.StructField("legalities", _URIS),
        T.StructField("card_faces", T.ArrayType(FACE)),
    ]
)

# The flat record that is stored: 19 columns, fixed names.
CARD = T.StructType(
    [
        T.StructField("scryfall_id", _TEXT),
        T.StructField("name", _TEXT),
        T.StructField("mana_cost", _TEXT),
        T.StructField("cmc", T.DoubleType()),
        T.StructField("type_line", _TEXT),
        T.StructField("oracle_text", _TEXT),
        T.StructField("power", _TEXT),
        T.StructField("toughness", _TEXT),
        T.StructField("colors", _TEXTS),
        T.StructField("color_identity", _TEXTS),
        T.StructField("keywords", _TEXTS),
        T.StructField("edhrec_rank", T.IntegerType()),
        T.StructField("set", _TEXT),
        T.StructField("collector_number", _TEXT),
        T.StructField("rarity", _TEXT),
        T.StructField("layout", _TEXT),
        T.StructField("image_small", _TEXT),
        T.StructField("image_normal", _TEXT),
        T.StructField("legalities", _TEXT),
    ]
)

# Vectors live in a table of their own, so that metadata scans never read them.
VECTOR = T.StructType(
    [
        T.StructField("id", _TEXT),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("model", _TEXT),
        T.StructField("include_name", T.BooleanType()),
        T.StructField("tags_weight", T.IntegerType()),
        T.StructField("text_hash", _TEXT),
    ]
)

BATCH_OBJECT = T.StructType(
    [
        T.StructField("class", _TEXT),
        T.StructField("id", _TEXT),
        T.StructField("properties", CARD),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)
BATCH_FILE = T.StructType([T.StructField("objects", T.ArrayType(BATCH_OBJECT))])

BULK_INDEX = T.StructType(
    [
        T.StructField(
            "data",
            T.ArrayType(
                T.StructType(
                    [T.StructField("type", _TEXT), T.StructField("download_uri", _TEXT)]
                )
            ),
        )
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("run", _TEXT),
        T.StructField("batch_id", T.LongType()),
        T.StructField("next_offset", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("last_batch_out", _TEXT),
        T.StructField("model", _TEXT),
        T.StructField("include_name", T.BooleanType()),
        T.StructField("kind", _TEXT),
    ]
)


def assert_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Return ``df`` if it has the expected columns and types, in any order."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [
        f"{f.name}: {have.get(f.name, 'missing')} instead of {f.dataType.simpleString()}"
        for f in expected.fields
        if have.get(f.name) != f.dataType.simpleString()
    ]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df


def ensure_table(spark: SparkSession, name: str, schema: T.StructType) -> bool:
    """Create an empty Parquet table if there is none; True when it was created.

    Either way a zero-row read proves that the table answers with the schema.
    """
    created = not spark.catalog.tableExists(name)
    if created:
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(name)
    assert_schema(spark.table(name).limit(0), schema)
    return created
