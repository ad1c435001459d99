"""Raw records to the flat card table and to the text an encoder reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.functions import text as X
from likeness.functions.tags import CARD_RULES, Rule, card_tags


def drop_without_id(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("id") != "")


def flatten_cards(raw: DataFrame) -> DataFrame:
    """The 19 stored columns; only name, cmc and edhrec_rank may stay NULL."""
    plain = ["mana_cost", "type_line", "power", "toughness", "set", "collector_number"]
    plain += ["rarity", "layout"]
    lists = ["colors", "color_identity", "keywords"]
    col = {name: X.or_empty(F.col(name)) for name in plain}
    col |= {name: X.or_no_items(F.col(name)) for name in lists}
    uris, faces = F.col("image_uris"), F.col("card_faces")
    return raw.select(
        F.col("id").alias("scryfall_id"),
        "name",
        col["mana_cost"].alias("mana_cost"),
        F.col("cmc").cast("double").alias("cmc"),
        col["type_line"].alias("type_line"),
        X.stored_text(F.col("oracle_text"), faces).alias("oracle_text"),
        col["power"].alias("power"),
        col["toughness"].alias("toughness"),
        col["colors"].alias("colors"),
        col["color_identity"].alias("color_identity"),
        col["keywords"].alias("keywords"),
        F.col("edhrec_rank").cast("int").alias("edhrec_rank"),
        col["set"].alias("set"),
        col["collector_number"].alias("collector_number"),
        col["rarity"].alias("rarity"),
        col["layout"].alias("layout"),
        X.image_uri(uris, faces, "small").alias("image_small"),
        X.image_uri(uris, faces, "normal").alias("image_normal"),
        X.legalities_json(F.col("legalities")).alias("legalities"),
    )


def tagged_text(raw: DataFrame, rules: Sequence[Rule] = CARD_RULES) -> DataFrame:
    """(id, name, type_line, mana_cost, colors, text, tags) of records with an id."""
    described = drop_without_id(raw).select(
        "id",
        X.or_empty(F.col("name")).alias("name"),
        X.or_empty(F.col("type_line")).alias("type_line"),
        X.or_empty(F.col("mana_cost")).alias("mana_cost"),
        X.or_no_items(F.col("colors")).alias("colors"),
        X.described_text(F.col("oracle_text"), F.col("card_faces")).alias("text"),
    )
    return described.withColumn("tags", card_tags(F.col("type_line"), F.col("text"), rules))


def embedding_texts(
    raw: DataFrame,
    include_name: bool = False,
    tags_weight: int = 1,
    rules: Sequence[Rule] = CARD_RULES,
) -> DataFrame:
    """(id, text): what the encoder is given for each record with an id."""
    built = X.embedding_text(
        F.col("name"),
        F.col("type_line"),
        F.col("mana_cost"),
        F.col("colors"),
        F.col("tags"),
        F.col("text"),
        include_name,
        tags_weight,
    )
    return tagged_text(raw, rules).select("id", built.alias("text"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    """(tag, n): how many records carry each tag."""
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
