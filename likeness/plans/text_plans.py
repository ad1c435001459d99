"""Registered queries: records, texts and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.functions import text as X
from likeness.functions.tags import Threshold, Words, card_tags, unify_wording
from likeness.operators import flatten
from likeness.operators.browse import legality_rows
from likeness.plans import tables as V
from likeness.plans.registry import query

# Rules over words that do occur in the documents; the type line is language and source.
CORPUS_RULES = (
    Words("in_en", ("en src",), in_type=True),
    Words("in_de", ("de src",), in_type=True),
    Words("the", ("the ",)),
    Words("the_of", ("the ", " of ")),
    Words("und_or_et", (" ",), either=(" und ", " et ")),
    Words("and_not_of", (" and ",), unless=(" of ",)),
    Words("mail", ("@",)),
    Threshold("number_", r"([0-9]+)"),
    Words("que", (" que ",)),
)

_TYPE_TOKENS = ["enchantment", "aura", "equipment", "artifact", "creature", "planeswalker"]
_TYPE_TOKENS += ["legendary"]


def _has(*words: str) -> str:
    return " AND ".join(f"contains(ot, '{w}')" for w in words)


_SEARCH = _has("search your library")
_ONTO = _has("put", "onto the battlefield")
_HAND = "contains(ot, 'reveal') OR contains(ot, 'put it into your hand')"
_CARD_CASES = [
    *[(f"contains(tl, '{t}') OR contains(ot, '{t}')", f"'type_{t}'") for t in _TYPE_TOKENS],
    (_SEARCH, "'tutor'"),
    (f"{_SEARCH} AND {_ONTO}", "'tutor_to_battlefield'"),
    (f"{_SEARCH} AND NOT ({_ONTO}) AND ({_HAND})", "'tutor_to_hand'"),
    (_has("onto the battlefield"), "'cheat_battlefield'"),
    (_has("whenever", "attacks"), "'attack_trigger'"),
    (_has("whenever", "enters the battlefield"), "'etb_trigger'"),
    ("mv <> ''", "'mv_leq_' || mv"),
    (_has("aura"), "'kw_aura'"),
    (_has("constellation"), "'kw_constellation'"),
    (_has("mentor"), "'kw_mentor'"),
    (_has("equip"), "'kw_equip'"),
    (_has("sagas"), "'kw_saga'"),
    (_has("tutor"), "'kw_tutor'"),
]


def _tag_list(cases: list[tuple[str, str]]) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in cases)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SQL_TAGGED = f"""
lowered AS (
  SELECT id, coalesce(name, '') AS name, coalesce(type_line, '') AS type_line,
    coalesce(mana_cost, '') AS mana_cost, coalesce(colors, []) AS colors,
    described_text AS text, lower(coalesce(type_line, '')) AS tl,
    lower(replace(described_text, 'converted mana cost', 'mana value')) AS ot
  FROM stored),
numbered AS (
  SELECT *, regexp_extract(ot, 'mana value ([0-9]+) or less', 1) AS mv FROM lowered),
tagged AS (SELECT *, {_tag_list(_CARD_CASES)} AS tags FROM numbered)
"""

_WORDS = {"W": "White", "U": "Blue", "B": "Black", "R": "Red", "G": "Green"}
_WORD_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _WORDS.items())
SQL_COLOR_WORDS = f"""CASE WHEN len(coalesce(colors, [])) = 0 THEN 'Colorless' ELSE
  array_to_string(list_transform(colors, lambda c: CASE c {_WORD_CASE} ELSE c END), '/') END"""


@query(
    "s2_drop_without_id",
    """
    SELECT CAST(l.doc_id AS VARCHAR) AS id, d.source, d.n_chars
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def s2_drop_without_id(spark, sf_dir):
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"))
    docs = V.table(spark, sf_dir, "documents")
    raw = docs.join(labels, docs["doc_id"] == labels["labelled"], "left").select(
        F.when(docs["doc_id"] % 2 == 0, F.col("labelled").cast("string"))
        .otherwise(F.coalesce(F.col("labelled").cast("string"), F.lit("")))
        .alias("id"),
        "source",
        "n_chars",
    )
    return flatten.drop_without_id(raw)


@query(
    "p1_flatten_cards",
    V.with_ctes(V.SQL_RAW)
    + """SELECT id AS scryfall_id, name, coalesce(mana_cost, '') AS mana_cost, cmc,
      coalesce(type_line, '') AS type_line, stored_text AS oracle_text,
      coalesce(power, '') AS power, coalesce(toughness, '') AS toughness,
      coalesce(array_to_string(colors, ','), '') AS colors,
      coalesce(array_to_string(color_identity, ','), '') AS color_identity,
      coalesce(array_to_string(keywords, ','), '') AS keywords, edhrec_rank,
      coalesce("set", '') AS "set", coalesce(collector_number, '') AS collector_number,
      coalesce(rarity, '') AS rarity, coalesce(layout, '') AS layout,
      image_small, image_normal, legalities FROM stored""",
)
def p1_flatten_cards(spark, sf_dir):
    flat = flatten.flatten_cards(V.raw_cards(spark, sf_dir))
    lists = ["colors", "color_identity", "keywords"]
    return flat.withColumns({c: F.array_join(c, ",") for c in lists})


@query(
    "p2_stored_text",
    V.with_ctes(V.SQL_RAW) + "SELECT id, stored_text AS oracle_text FROM stored",
)
def p2_stored_text(spark, sf_dir):
    raw = V.raw_cards(spark, sf_dir)
    built = X.stored_text(F.col("oracle_text"), F.col("card_faces"))
    return raw.select("id", built.alias("oracle_text"))


@query(
    "p3_described_text",
    V.with_ctes(V.SQL_RAW) + "SELECT id, described_text AS text FROM stored",
)
def p3_described_text(spark, sf_dir):
    raw = V.raw_cards(spark, sf_dir)
    return raw.select(
        "id", X.described_text(F.col("oracle_text"), F.col("card_faces")).alias("text")
    )


@query(
    "p4_image_uris",
    V.with_ctes(V.SQL_RAW) + "SELECT id, image_small, image_normal FROM stored",
)
def p4_image_uris(spark, sf_dir):
    uris, faces = F.col("image_uris"), F.col("card_faces")
    return V.raw_cards(spark, sf_dir).select(
        "id",
        X.image_uri(uris, faces, "small").alias("image_small"),
        X.image_uri(uris, faces, "normal").alias("image_normal"),
    )


@query("p5_legalities_json", V.with_ctes(V.SQL_RAW) + "SELECT id, legalities FROM raw")
def p5_legalities_json(spark, sf_dir):
    raw = V.raw_cards(spark, sf_dir)
    return raw.select("id", X.legalities_json(F.col("legalities")).alias("legalities"))


@query(
    "p6_parse_json_map",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k,
      CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events""",
)
def p6_parse_json_map(spark, sf_dir):
    parsed = X.parse_legalities(F.col("props"))
    return V.table(spark, sf_dir, "events").select(
        "event_id",
        F.try_element_at(parsed, F.lit("k")).alias("k"),
        F.size(parsed).alias("n_keys"),
    )


@query(
    "p7_legality_rows",
    V.with_ctes(V.SQL_CARDS)
    + """, parsed AS (SELECT id, legalities AS j FROM cards WHERE starts_with(legalities, '{'))
    SELECT id, unnest(json_keys(j)) AS format,
      json_extract_string(j, unnest(json_keys(j))) AS status FROM parsed""",
)
def p7_legality_rows(spark, sf_dir):
    return legality_rows(V.cards(spark, sf_dir)).orderBy("id", "format")


@query(
    "p8_color_words",
    V.with_ctes(V.SQL_CARDS) + f"SELECT id, {SQL_COLOR_WORDS} AS colors FROM cards",
)
def p8_color_words(spark, sf_dir):
    return V.cards(spark, sf_dir).select("id", X.color_words(F.col("colors")).alias("colors"))


@query(
    "p9_unify_wording",
    V.with_ctes(V.SQL_RAW, SQL_TAGGED) + "SELECT id, ot AS text FROM lowered",
)
def p9_unify_wording(spark, sf_dir):
    raw = V.raw_cards(spark, sf_dir)
    text = X.described_text(F.col("oracle_text"), F.col("card_faces"))
    return raw.select("id", unify_wording(text).alias("text"))


@query(
    "p10_p15_card_tags",
    V.with_ctes(V.SQL_RAW, SQL_TAGGED) + "SELECT id, array_to_string(tags, ' ') AS tags FROM tagged",
)
def p10_p15_card_tags(spark, sf_dir):
    tagged = flatten.tagged_text(V.raw_cards(spark, sf_dir))
    return tagged.select("id", F.array_join("tags", " ").alias("tags"))


_CORPUS_CASES = [
    ("contains(tl, 'en src') OR contains(ot, 'en src')", "'in_en'"),
    ("contains(tl, 'de src') OR contains(ot, 'de src')", "'in_de'"),
    (_has("the "), "'the'"),
    (_has("the ", " of "), "'the_of'"),
    (f"{_has(' ')} AND (contains(ot, ' und ') OR contains(ot, ' et '))", "'und_or_et'"),
    (f"{_has(' and ')} AND NOT {_has(' of ')}", "'and_not_of'"),
    (_has("@"), "'mail'"),
    ("mv <> ''", "'number_' || mv"),
    (_has(" que "), "'que'"),
]


@query(
    "p10_p15_corpus_tags",
    f"""
    WITH lowered AS (
      SELECT doc_id, lower(lang || ' ' || source) AS tl,
        lower(replace(text, 'converted mana cost', 'mana value')) AS ot FROM documents),
    numbered AS (SELECT *, regexp_extract(ot, '([0-9]+)', 1) AS mv FROM lowered)
    SELECT doc_id, array_to_string({_tag_list(_CORPUS_CASES)}, ' ') AS tags FROM numbered""",
)
def p10_p15_corpus_tags(spark, sf_dir):
    kind = F.concat_ws(" ", "lang", "source")
    tags = card_tags(kind, F.col("text"), CORPUS_RULES)
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(tags, " ").alias("tags")
    )


def embedding_sql(include_name: bool, weight: int) -> str:
    name = "CASE WHEN name <> '' THEN 'Name: ' || name END," if include_name else ""
    tag = "CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ' ') END"
    return f"""array_to_string(list_filter([{name}
      CASE WHEN type_line <> '' THEN 'Type: ' || type_line END,
      CASE WHEN mana_cost <> '' THEN 'ManaCost: ' || mana_cost END,
      'Colors: ' || {SQL_COLOR_WORDS},
      {", ".join([tag] * max(1, weight))},
      CASE WHEN text <> '' THEN 'Oracle: ' || text END], lambda x: x IS NOT NULL), chr(10))"""


@query(
    "p16_embedding_text",
    V.with_ctes(V.SQL_RAW, SQL_TAGGED)
    + f"""SELECT id, {embedding_sql(False, 0)} AS plain, {embedding_sql(True, 3)} AS named
    FROM tagged""",
)
def p16_embedding_text(spark, sf_dir):
    tagged = flatten.tagged_text(V.raw_cards(spark, sf_dir))
    fields = [F.col(c) for c in ["name", "type_line", "mana_cost", "colors", "tags", "text"]]
    return tagged.select(
        "id",
        X.embedding_text(*fields, include_name=False, tags_weight=0).alias("plain"),
        X.embedding_text(*fields, include_name=True, tags_weight=3).alias("named"),
    )


@query(
    "p19_card_page",
    V.with_ctes(V.SQL_CARDS)
    + """SELECT id, CASE
      WHEN rarity <> 'promo' AND collector_number <> ''
        THEN 'https://scryfall.com/card/' || "set" || '/' || collector_number
      WHEN "set" <> 'Brand#7' THEN 'https://scryfall.com/card/' || id
      ELSE 'https://scryfall.com/' END AS page FROM cards""",
)
def p19_card_page(spark, sf_dir):
    known_set = F.when(F.col("rarity") != "promo", F.col("set")).otherwise("")
    known_id = F.when(F.col("set") != "Brand#7", F.col("id")).otherwise("")
    return V.cards(spark, sf_dir).select(
        "id", X.card_page(known_set, F.col("collector_number"), known_id).alias("page")
    )


@query(
    "p20_display_fields",
    V.with_ctes(V.SQL_CARDS)
    + """SELECT id,
      CASE WHEN power <> '' OR toughness <> '' THEN power || '/' || toughness ELSE '' END AS stats,
      coalesce(array_to_string(colors, '/'), '') AS colors,
      coalesce(array_to_string(colors, ', '), '') AS keywords, upper("set") AS "set",
      CASE WHEN cmc > 0 THEN printf('%.0f', cmc) ELSE '' END AS mana_value,
      CASE WHEN cmc > 2 THEN printf('sim %.3f', (cmc - 2) / 7) ELSE '' END AS sim FROM cards""",
)
def p20_display_fields(spark, sf_dir):
    colors = F.col("colors")
    return V.cards(spark, sf_dir).select(
        "id",
        X.stats_label(F.col("power"), F.col("toughness")).alias("stats"),
        X.list_label(colors, "/").alias("colors"),
        X.list_label(colors, ", ").alias("keywords"),
        F.upper("set").alias("set"),
        X.mana_value_label(F.col("cmc")).alias("mana_value"),
        X.similarity_label((F.col("cmc") - 2) / 7).alias("sim"),
    )


@query(
    "p21_parse_int",
    V.with_ctes(V.SQL_CARDS)
    + """SELECT id, CASE WHEN regexp_full_match(collector_number, '[+-]?[0-9]+')
        THEN CAST(collector_number AS BIGINT) ELSE -1 END AS number,
      CASE WHEN power <> '' THEN CAST(power AS BIGINT) ELSE 20 END AS power FROM cards""",
)
def p21_parse_int(spark, sf_dir):
    return V.cards(spark, sf_dir).select(
        "id",
        X.parse_int(F.col("collector_number"), -1).alias("number"),
        X.parse_int(F.col("power"), 20).alias("power"),
    )


@query(
    "p22_first_non_empty",
    V.with_ctes(V.SQL_CARDS)
    + "SELECT id, CASE WHEN power <> '' THEN power ELSE name END AS label FROM cards",
)
def p22_first_non_empty(spark, sf_dir):
    return V.cards(spark, sf_dir).select(
        "id", X.first_non_empty(F.col("power"), F.col("name")).alias("label")
    )


@query(
    "a5_tag_counts",
    V.with_ctes(V.SQL_RAW, SQL_TAGGED)
    + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag",
)
def a5_tag_counts(spark, sf_dir):
    return flatten.tag_counts(flatten.tagged_text(V.raw_cards(spark, sf_dir)))
