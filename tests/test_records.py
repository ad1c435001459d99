import json

import pytest
from cards import RAW
from likeness.functions import text as X
from likeness.functions.tags import Words, card_tags
from likeness.operators import filters
from likeness.operators.flatten import embedding_texts, flatten_cards, tagged_text
from likeness.schema import CARD, assert_schema, ensure_table
from likeness.sources.cards import bulk_address, read_cards, store_cards
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "cards.json"
    path.write_text(json.dumps(RAW, indent=1))
    return read_cards(spark, str(path), "array").cache()


@pytest.fixture(scope="module")
def flat(raw):
    return {r["scryfall_id"]: r for r in flatten_cards(raw).collect()}


@pytest.fixture(scope="module")
def tags(raw):
    return {r["id"]: r["tags"] for r in tagged_text(raw).collect()}


def test_layouts_read_alike(spark, raw, tmp_path):
    lines = tmp_path / "cards.jsonl"
    lines.write_text("\n".join(json.dumps(r) for r in RAW))
    array = tmp_path / "cards.json"
    array.write_text("[\n" + ",\n".join(json.dumps(r) for r in RAW) + "\n]\n")
    want = sorted(map(str, raw.collect()))
    assert sorted(map(str, read_cards(spark, str(lines), "lines").collect())) == want
    assert sorted(map(str, read_cards(spark, str(array), "array_lines").collect())) == want
    store_cards(raw, str(tmp_path / "stored"), 3)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "stored")).collect())) == want


def test_broken_file_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": "a"}, {"id": ')
    with pytest.raises(Exception, match="MALFORMED"):
        read_cards(spark, str(tmp_path / "bad.json"), "array").collect()


def test_flat_schema(raw):
    flat = assert_schema(flatten_cards(raw), CARD)
    assert flat.columns == CARD.fieldNames()
    with pytest.raises(ValueError, match="rarity: missing"):
        assert_schema(flat.drop("rarity"), CARD)


def test_defaults(flat):
    row = flat["no-text"]
    assert row["cmc"] is None and row["edhrec_rank"] is None
    assert row["colors"] == [] and row["keywords"] == []
    assert [row[c] for c in ("mana_cost", "type_line", "oracle_text", "set", "legalities")] == [""] * 5
    assert flat["plain"]["cmc"] == 3.0 and flat["faces"]["cmc"] == 0.5


def test_face_texts(raw, flat):
    assert flat["faces"]["oracle_text"] == "Flying. || Reach."
    texts = {r["id"]: r["text"] for r in tagged_text(raw).collect()}
    assert texts["faces"] == "Creature :: Flying. || Aura ::  ||  :: Reach."


def test_images(flat):
    assert flat["null-image"]["image_normal"] == ""
    assert flat["null-image"]["image_small"] == "s2"
    assert (flat["faces"]["image_normal"], flat["faces"]["image_small"]) == ("f1", "s2")
    assert flat["plain"]["image_normal"] == "n"


def test_legalities(spark, flat):
    assert flat["plain"]["legalities"] == '{"standard":"legal","modern":"banned"}'
    assert flat["null-image"]["legalities"] == ""
    rows = spark.createDataFrame([('{"a":"b"}',), ("no json",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(X.parse_legalities(F.col("t"))).collect()]
    assert got == [{"a": "b"}, {}, {}, {}]


def test_tags(tags):
    assert tags["battlefield"] == ["tutor", "tutor_to_battlefield", "cheat_battlefield"]
    assert tags["hand"] == ["tutor", "tutor_to_hand"]
    assert tags["low"] == ["mv_leq_3"] and tags["high"] == []
    assert tags["aura"] == ["type_aura", "kw_aura"]
    assert tags["attack"] == [
        "type_enchantment", "type_legendary", "attack_trigger", "etb_trigger", "kw_mentor",
    ]
    assert tags["faces"] == ["type_aura", "type_creature", "kw_aura"]
    assert "" not in tags and None not in tags


def test_equal_tags_of_two_rules_come_once(spark):
    rules = (Words("a", ("x",)), Words("b", ("y",)), Words("a", ("y",)))
    rows = spark.createDataFrame([("X y",), ("y",), ("",)], "t string")
    got = [r[0] for r in rows.select(card_tags(F.lit(""), F.col("t"), rules)).collect()]
    assert got == [["a", "b"], ["b", "a"], []]


@pytest.mark.parametrize(("weight", "lines"), [(0, 1), (1, 1), (3, 3)])
def test_tag_weight(raw, weight, lines):
    texts = {r["id"]: r["text"] for r in embedding_texts(raw, tags_weight=weight).collect()}
    assert texts["aura"].count("Tags: type_aura kw_aura") == lines
    assert texts["no-text"] == "Colors: Colorless"


def test_embedding_text(raw):
    texts = {r["id"]: r["text"] for r in embedding_texts(raw, include_name=True).collect()}
    assert texts["plain"] == (
        "Name: Plain\nType: Creature\nColors: Blue/Red\nTags: type_creature\nOracle: Vigilance."
    )
    assert texts["odd-color"] == "Name: Odd\nManaCost: {2}\nColors: X"
    assert len(texts) == len(RAW) - 2


def test_parse_int(spark):
    texts = ["7", "+7", "-7", " 7 ", "", "x", "99999999999999999999", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(X.parse_int(F.col("t"), 5)).collect()]
    assert got == [7, 7, -7, 5, 5, 5, 5, 5]


def test_mana_value_label_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (0.0,), (None,)], "v double")
    got = [r[0] for r in rows.select(X.mana_value_label(F.col("v"))).collect()]
    assert got == ["0", "2", "2", "", ""]


def test_filters(spark):
    rows = spark.createDataFrame(
        [(["w ", "U"], 2.9), ([], None), (None, -0.5)], "colors array<string>, cmc double"
    )
    colors, cmc = F.col("colors"), F.col("cmc")

    def got(column):
        return [r[0] for r in rows.select(column).collect()]

    assert got(filters.has_all_colors(colors, F.lit("u, W"))) == [True, False, False]
    assert got(filters.has_all_colors(colors, F.lit(","))) == [True, True, True]
    assert got(filters.has_all_colors(colors, F.lit(None))) == [True, True, True]
    assert got(filters.mana_value_between(cmc, F.lit(0), F.lit(2))) == [True, True, True]
    assert got(filters.mana_value_between(cmc, F.lit(2), F.lit(-1))) == [True, False, False]


def test_bulk_index(spark, tmp_path):
    entries = [
        {"type": "a", "download_uri": "u1"},
        {"type": "b", "download_uri": "u2"},
        {"type": "b", "download_uri": "u3"},
        {"type": "c"},
    ]
    path = tmp_path / "index.json"
    path.write_text(json.dumps({"data": entries}, indent=2))
    assert bulk_address(spark, str(path), "b") == "u2"
    for kind in ("c", "d"):
        with pytest.raises(LookupError):
            bulk_address(spark, str(path), kind)


def test_ensure_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shop LOCATION '{tmp_path}/shop'")
    try:
        assert ensure_table(spark, "shop.cards", CARD)
        assert not ensure_table(spark, "shop.cards", CARD)
        with pytest.raises(ValueError, match="vector: missing"):
            more = T.StructField("vector", T.ArrayType(T.FloatType()))
            ensure_table(spark, "shop.cards", T.StructType([*CARD.fields, more]))
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_half_way_labels_round_to_even(spark):
    from likeness.functions.text import similarity_label, trimmed

    rows = [(0.0625,), (0.1875,), (0.3125,), (0.9375,), (0.12345,), (0.0005,), (1.0,), (-0.5,)]
    df = spark.createDataFrame(rows, "s double").select(similarity_label(F.col("s")).alias("l"))
    assert [r["l"] for r in df.collect()] == [
        f"sim {s:.3f}" if s > 0 else "" for (s,) in rows
    ]
    names = spark.createDataFrame([("\t Bolt\n",), ("\u3000\xa0",), ("a\tb",)], "n string")
    assert [r[0] for r in names.select(trimmed(F.col("n"))).collect()] == ["Bolt", "", "a\tb"]


def test_a_broken_batch_file_is_not_counted(spark, tmp_path):
    from likeness.sources.batches import count_objects

    (tmp_path / "bad.json").write_text('{"objects":[{"id":"a"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        count_objects(spark, str(tmp_path / "bad.json"))
