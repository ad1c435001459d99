"""The given tables seen as cards, vectors and requests, in Spark and in SQL.

Each view is built twice, once per engine, by the same formulas. All of them read their
tables whole and grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.functions.text import SPACE

# What a card says, by size; chosen so that every tag rule has cards it applies to.
PHRASES = [
    "Search your library for a card, put it onto the battlefield.",
    "Search your library for a card, reveal it, put it into your hand.",
    "Whenever this creature attacks, destroy an artifact with converted mana cost 3 or less.",
    "Whenever an Aura enters the battlefield, draw a card.",
    "Converted mana cost 2 or less. Equip {2}. Mentor.",
    "Mana value 12 or less. Constellation. Sagas you control.",
    "",
    "Read ahead (Sagas). Equipped creature gets +1/+1. Planeswalker tutor.",
]
TYPE_LINES = {
    "PROMO": "Legendary Creature",
    "STANDARD": "Creature",
    "LARGE": "Legendary Artifact",
    "MEDIUM": "Artifact Equipment",
    "SMALL": "Enchantment Aura",
}
OTHER_TYPE_LINE = "Legendary Enchantment"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _type_line() -> Column:
    (first, line), *others = TYPE_LINES.items()
    kind = F.when(F.col("p_type") == first, line)
    for value, line in others:
        kind = kind.when(F.col("p_type") == value, line)
    return kind.otherwise(OTHER_TYPE_LINE)


def _phrase() -> Column:
    return F.get(F.array(*[F.lit(p) for p in PHRASES]), F.col("p_size") % len(PHRASES))


def _colors(key: Column) -> Column:
    codes = [
        F.when(F.floor(key / 2**bit) % 2 == 1, F.lit(code)) for bit, code in enumerate("WUBRG")
    ]
    return F.when(F.col("p_brand") != "Brand#7", F.array_compact(F.array(*codes)))


def _number(key: Column) -> Column:
    return F.concat(F.col("p_size").cast("string"), F.when(key % 7 == 0, "a").otherwise(""))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``part`` as flat cards."""
    key = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    creature = F.contains(_type_line(), F.lit("Creature"))
    legal = F.concat(
        F.lit('{"modern":"'),
        F.when(F.col("p_size") % 2 == 0, "legal").otherwise("banned"),
        F.lit('","standard":"'),
        F.when(F.col("p_size") % 3 == 0, "legal").otherwise("not_legal"),
        F.lit('"}'),
    )
    return table(spark, sf_dir, "part").select(
        key.cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("{"), size, F.lit("}")).alias("mana_cost"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 10).alias("cmc"),
        _type_line().alias("type_line"),
        _phrase().alias("oracle_text"),
        F.when(creature, size).otherwise("").alias("power"),
        F.when(creature & (F.col("p_size") > 25), "*").otherwise("").alias("toughness"),
        _colors(key).alias("colors"),
        F.col("p_brand").alias("set"),
        _number(key).alias("collector_number"),
        F.lower("p_type").alias("rarity"),
        F.when(key % 5 != 0, F.concat(F.lit("img/"), key.cast("string"))).otherwise("").alias(
            "image_normal"
        ),
        F.when(F.col("p_size") % 5 != 0, legal)
        .when(F.col("p_size") % 2 == 0, "not json")
        .otherwise("")
        .alias("legalities"),
    )


def _sql_case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL_TYPE_LINE = _sql_case(
    [(f"p_type = {_quoted(k)}", _quoted(v)) for k, v in TYPE_LINES.items()],
    _quoted(OTHER_TYPE_LINE),
)
SQL_PHRASE = _sql_case(
    [(f"p_size % 8 = {i}", _quoted(p)) for i, p in enumerate(PHRASES[:-1])], _quoted(PHRASES[-1])
)


def _sql_colors(key: str) -> str:
    codes = [
        f"CASE WHEN ({key} // {2**bit}) % 2 = 1 THEN '{code}' END"
        for bit, code in enumerate("WUBRG")
    ]
    listed = f"list_filter([{', '.join(codes)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN p_brand <> 'Brand#7' THEN {listed} END"


SQL_CARDS = f"""
typed AS (SELECT *, {SQL_TYPE_LINE} AS type_line FROM part),
cards AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
    '{{' || p_size || '}}' AS mana_cost,
    CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) / 10 END AS cmc,
    type_line, {SQL_PHRASE} AS oracle_text,
    CASE WHEN contains(type_line, 'Creature') THEN CAST(p_size AS VARCHAR) ELSE '' END AS power,
    CASE WHEN contains(type_line, 'Creature') AND p_size > 25 THEN '*' ELSE '' END AS toughness,
    {_sql_colors('p_partkey')} AS colors,
    p_brand AS "set",
    p_size || CASE WHEN p_partkey % 7 = 0 THEN 'a' ELSE '' END AS collector_number,
    lower(p_type) AS rarity,
    CASE WHEN p_partkey % 5 <> 0 THEN 'img/' || p_partkey ELSE '' END AS image_normal,
    CASE WHEN p_size % 5 <> 0 THEN
      '{{"modern":"' || CASE WHEN p_size % 2 = 0 THEN 'legal' ELSE 'banned' END ||
      '","standard":"' || CASE WHEN p_size % 3 = 0 THEN 'legal' ELSE 'not_legal' END || '"}}'
      WHEN p_size % 2 = 0 THEN 'not json' ELSE '' END AS legalities
  FROM typed)
"""


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records from ``part`` and ``documents``, each row of either once.

    English texts are a record's own text; texts in other languages are faces, one per
    line. Parts without a document carry their phrase alone.
    """
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    joined = part.join(docs, F.col("p_partkey") == F.col("doc_id"), "full_outer")
    key = F.coalesce("p_partkey", "doc_id")
    phrase = F.coalesce(_phrase(), F.lit(""))
    own = (
        F.when(F.col("lang").isNull(), phrase)
        .when(F.col("lang") == "en", F.concat(phrase, F.lit(" "), F.col("text")))
        .when(key % 2 == 0, "")
    )

    def face(line: Column) -> Column:
        uri = F.create_map(F.lit("normal"), F.concat(F.lit("face/"), F.col("source")))
        return F.struct(
            F.when(F.col("lang") != "de", F.col("source")).alias("type_line"),
            line.alias("oracle_text"),
            F.when(F.length(line) % 2 == 0, uri).alias("image_uris"),
        )

    faces = F.when(F.col("lang") != "en", F.transform(F.split("text", "\n"), face))
    address = F.concat(F.lit("img/"), key.cast("string"))
    uris = (
        F.when(F.col("p_size") % 4 == 0, F.create_map(F.lit("normal"), address))
        .when(
            F.col("p_size") % 4 == 1, F.create_map(F.lit("normal"), F.lit(None).cast("string"))
        )
        .when(F.col("p_size") % 4 == 2, F.create_map(F.lit("small"), address))
    )
    legal = F.create_map(
        F.lit("modern"),
        F.when(F.col("p_size") % 2 == 0, "legal").otherwise("banned"),
        F.lit("standard"),
        F.coalesce("lang", F.lit("none")),
    )
    return joined.select(
        key.cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 6 != 0, F.concat(F.lit("{"), F.col("p_size"), F.lit("}"))).alias(
            "mana_cost"
        ),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 10).alias("cmc"),
        F.when(F.col("p_size") % 9 != 0, _type_line()).alias("type_line"),
        own.alias("oracle_text"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("power"),
        F.lit(None).cast("string").alias("toughness"),
        _colors(key).alias("colors"),
        F.lit(None).cast("array<string>").alias("color_identity"),
        F.when(F.col("p_size") > 9, F.split("p_name", " ")).alias("keywords"),
        F.when(key % 3 != 0, key.cast("int")).alias("edhrec_rank"),
        F.col("p_brand").alias("set"),
        _number(key).alias("collector_number"),
        F.lower("p_type").alias("rarity"),
        F.col("source").alias("layout"),
        uris.alias("image_uris"),
        F.when(F.col("p_size") % 3 == 0, F.create_map().cast("map<string,string>"))
        .when(F.col("p_size") % 3 == 1, legal)
        .alias("legalities"),
        faces.alias("card_faces"),
    )


SQL_RAW = f"""
typed AS (SELECT *, {SQL_TYPE_LINE} AS type_line FROM part),
pairs AS (
  SELECT *, coalesce(p_partkey, doc_id) AS key
  FROM typed FULL OUTER JOIN documents ON p_partkey = doc_id),
raw AS (
  SELECT CAST(key AS VARCHAR) AS id, p_name AS name,
    CASE WHEN p_size % 6 <> 0 THEN '{{' || p_size || '}}' END AS mana_cost,
    CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) / 10 END AS cmc,
    CASE WHEN p_size % 9 <> 0 THEN type_line END AS type_line,
    CASE WHEN lang IS NULL THEN ({SQL_PHRASE})
      WHEN lang = 'en' THEN (CASE WHEN p_size IS NULL THEN '' ELSE {SQL_PHRASE} END) || ' ' || text
      WHEN key % 2 = 0 THEN '' END AS oracle_text,
    CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS power,
    CAST(NULL AS VARCHAR) AS toughness,
    {_sql_colors('key')} AS colors,
    CAST(NULL AS VARCHAR[]) AS color_identity,
    CASE WHEN p_size > 9 THEN string_split(p_name, ' ') END AS keywords,
    CASE WHEN key % 3 <> 0 THEN CAST(key AS INTEGER) END AS edhrec_rank,
    p_brand AS "set",
    p_size || CASE WHEN key % 7 = 0 THEN 'a' ELSE '' END AS collector_number,
    lower(p_type) AS rarity, source AS layout,
    p_size, key, lang, source,
    CASE WHEN lang <> 'en' THEN string_split(text, chr(10)) END AS face_texts,
    CASE WHEN lang <> 'de' THEN source END AS face_type,
    CASE WHEN p_size % 3 = 1 THEN
      '{{"modern":"' || CASE WHEN p_size % 2 = 0 THEN 'legal' ELSE 'banned' END ||
      '","standard":"' || coalesce(lang, 'none') || '"}}' ELSE '' END AS legalities
  FROM pairs),
stored AS (
  SELECT *,
    CASE WHEN oracle_text <> '' THEN oracle_text ELSE coalesce(array_to_string(
      list_filter(face_texts, lambda t: t <> ''), ' || '), '') END AS stored_text,
    CASE WHEN oracle_text <> '' THEN oracle_text ELSE coalesce(array_to_string(
      list_transform(
        list_filter(face_texts, lambda t: t <> '' OR coalesce(face_type, '') <> ''),
        lambda t: coalesce(face_type, '') || ' :: ' || t), ' || '), '') END AS described_text,
    CASE WHEN p_size % 4 = 0 THEN 'img/' || key
      WHEN p_size % 4 = 1 THEN ''
      WHEN len(list_filter(face_texts, lambda t: length(t) % 2 = 0)) > 0 THEN 'face/' || source
      ELSE '' END AS image_normal,
    CASE WHEN p_size % 4 = 2 THEN 'img/' || key ELSE '' END AS image_small
  FROM raw)
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings`` as (id, vector)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")
    )


def grouped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, each pulled towards the first row of its label: vectors that lie
    in groups, as the given ones do not."""
    rows = table(spark, sf_dir, "embeddings").select(
        "label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own")
    )
    first = rows.groupBy("label").agg(F.min_by("own", "vec_id").alias("first"))
    pulled = F.zip_with("own", "first", lambda x, y: x + 2 * y)
    return rows.join(first, "label").select(F.col("vec_id").cast("string").alias("id"), pulled.alias("vector"))


SQL_GROUPED_VECTORS = """
vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS id,
    list_transform(list_zip(own, first), lambda z: z[1] + 2 * z[2]) AS vector
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS own, first_value(CAST(embedding AS DOUBLE[]))
    OVER (PARTITION BY label ORDER BY vec_id) AS first FROM embeddings))
"""

SQL_VECTORS = """
vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
pool AS (SELECT * FROM vectors WHERE id IN (SELECT id FROM cards)),
catalogue AS (SELECT * FROM cards WHERE id IN (SELECT id FROM vectors))
"""


def order_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One request per order, for the parts on it: (query_id, k) and (query_id, name).

    Names come as they are, padded, in capitals, with wildcards, blank or unknown.
    """
    quantity, name = F.col("l_quantity"), F.col("p_name")
    asked = (
        F.when(quantity == 50, F.concat(F.lit("no such part "), F.col("l_suppkey").cast("string")))
        .when(quantity == 49, " \t\u00a0")
        .when(quantity == 48, F.replace(name, F.lit(" "), F.lit("*")))
        .when(quantity == 47, F.concat(F.lit("?"), F.substring(name, 2, 100)))
        .when(F.col("l_returnflag") == "R", F.upper(name))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("\t "), name, F.lit("\n\u3000")))
        .otherwise(name)
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    named = lines.select(F.col("l_orderkey").alias("query_id"), asked.alias("name"))
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        (F.col("o_custkey") % 15 - 2).cast("int").alias("k"),
    )
    return requests, named.join(requests, "query_id", "left_semi")




def sql_trimmed(text: str) -> str:
    """``trimmed`` in SQL."""
    return f"trim({text}, {' || '.join(f'chr({ord(c)})' for c in SPACE)})"


# One row per name asked for, as ``named``; the requests themselves as ``asked``.
SQL_ORDER_REQUESTS = """
asked AS (
  SELECT o_orderkey AS query_id, CAST(o_custkey % 15 - 2 AS INTEGER) AS k FROM orders),
named AS (
  SELECT l_orderkey AS query_id, """ + sql_trimmed("""CASE
    WHEN l_quantity = 50 THEN 'no such part ' || l_suppkey
    WHEN l_quantity = 49 THEN ' ' || chr(9) || chr(160)
    WHEN l_quantity = 48 THEN replace(p_name, ' ', '*')
    WHEN l_quantity = 47 THEN '?' || substr(p_name, 2)
    WHEN l_returnflag = 'R' THEN upper(p_name)
    WHEN l_returnflag = 'N' THEN chr(9) || ' ' || p_name || chr(10) || chr(12288)
    ELSE p_name END""") + """ AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
"""

# (name, match_kind, matched_name, id) for each distinct name in ``named``.
SQL_RESOLVED = r"""
distinct_names AS (SELECT DISTINCT name FROM named WHERE name <> ''),
firsts AS (SELECT name, min(id) AS id FROM cards GROUP BY name),
candidates AS (
  SELECT d.name, f.name AS matched_name, f.id,
    row_number() OVER (PARTITION BY d.name ORDER BY f.name, f.id) AS place
  FROM distinct_names d JOIN firsts f ON lower(f.name) LIKE '%' || replace(replace(replace(
    replace(lower(d.name), '%', '\%'), '_', '\_'), '*', '%'), '?', '_') || '%' ESCAPE '\'
  WHERE d.name NOT IN (SELECT name FROM firsts)),
resolved AS (
  SELECT d.name,
    CASE WHEN f.id IS NOT NULL THEN 'exact' WHEN c.id IS NOT NULL THEN 'like' ELSE 'none' END
      AS match_kind,
    coalesce(f.name, c.matched_name) AS matched_name, coalesce(f.id, c.id) AS id
  FROM distinct_names d LEFT JOIN firsts f ON d.name = f.name
    LEFT JOIN candidates c ON d.name = c.name AND c.place = 1)
"""

# The items with a vector of requests all of whose names were found, as (query_id, id, n).
SQL_MEMBERS = """
found AS (SELECT n.query_id, r.id FROM named n JOIN resolved r ON n.name = r.name),
verdict AS (SELECT query_id, bool_and(id IS NOT NULL) AS complete FROM found GROUP BY query_id),
members AS (
  SELECT query_id, id, count(*) AS n FROM found
  WHERE query_id IN (SELECT query_id FROM verdict WHERE complete)
    AND id IN (SELECT id FROM vectors) GROUP BY query_id, id)
"""

# Unit centroids (query_id, vector) of ``members``.
SQL_CENTROIDS = """
items AS (
  SELECT m.query_id, m.n, unnest(v.vector) AS x, generate_subscripts(v.vector, 1) AS pos
  FROM members m JOIN vectors v ON m.id = v.id),
means AS (
  SELECT query_id, pos, sum(n * x) / sum(n) AS x FROM items GROUP BY query_id, pos),
lengths AS (SELECT query_id, sqrt(sum(x * x)) AS length FROM means GROUP BY query_id),
centroids AS (
  SELECT m.query_id, list(CASE WHEN length > 0 THEN x / length ELSE x END ORDER BY pos) AS vector
  FROM means m JOIN lengths l ON m.query_id = l.query_id GROUP BY m.query_id)
"""


def sql_distance(a: str, b: str) -> str:
    return f"(round(1 - list_cosine_similarity({a}, {b}), 12) + 0.0)"


def browse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One browsing request per supplier: by id or name, with filters and an order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows = table(spark, sf_dir, "supplier").join(part, F.col("s_suppkey") == F.col("p_partkey"))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    word = F.get(F.split("p_name", " "), F.lit(0))
    return rows.select(
        key.alias("query_id"),
        F.when(nation % 3 == 0, key.cast("string")).otherwise("").alias("id"),
        F.when(nation % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(nation % 4 == 0, F.upper(word))
        .when(nation % 4 == 1, F.concat(word, F.lit("*"), F.substring("p_name", -2, 2)))
        .when(nation % 4 == 2, F.concat(F.lit("\t"), F.substring("p_name", 2, 2), F.lit("\n")))
        .otherwise(F.col("p_name"))
        .alias("q"),
        F.when(nation % 5 != 0, F.col("p_size") * 12).alias("k"),
        (F.col("p_size") % 4 == 0).alias("legendary"),
        F.when(nation % 2 == 0, "\tENCHANT \n").otherwise("").alias("type_filter"),
        F.when(nation % 6 == 0, "\nw,\tu ").when(nation % 6 == 1, ",").otherwise("").alias(
            "colors_filter"
        ),
        F.when(nation % 7 == 0, 2).otherwise(-1).alias("cmc_min"),
        F.when(nation % 7 < 3, 3).alias("cmc_max"),
        F.when(nation % 5 == 1, "cmc")
        .when(nation % 5 == 2, "name")
        .when(nation % 5 == 3, "price")
        .otherwise("")
        .alias("sort"),
        F.when(nation % 3 == 0, "asc").when(nation % 3 == 1, "desc").otherwise("").alias("order"),
    )


SQL_BROWSE_REQUESTS = """
browse AS (
  SELECT s_suppkey AS query_id,
    CASE WHEN s_nationkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) ELSE '' END AS id,
    CASE WHEN s_nationkey % 3 = 1 THEN upper(p_name) ELSE p_name END AS name,
    CASE s_nationkey % 4 WHEN 0 THEN upper(split_part(p_name, ' ', 1))
      WHEN 1 THEN split_part(p_name, ' ', 1) || '*' || right(p_name, 2)
      WHEN 2 THEN substr(p_name, 2, 2) ELSE p_name END AS q,
    CASE WHEN s_nationkey % 5 <> 0 THEN p_size * 12 END AS k,
    p_size % 4 = 0 AS legendary,
    CASE WHEN s_nationkey % 2 = 0 THEN 'ENCHANT' ELSE '' END AS type_filter,
    CASE s_nationkey % 6 WHEN 0 THEN ['W', 'U'] ELSE [] END AS wanted,
    CASE WHEN s_nationkey % 7 = 0 THEN 2 ELSE -1 END AS cmc_min,
    CASE WHEN s_nationkey % 7 < 3 THEN 3 END AS cmc_max,
    CASE s_nationkey % 5 WHEN 1 THEN 'cmc' WHEN 2 THEN 'name' WHEN 3 THEN 'price' ELSE '' END
      AS sort,
    CASE s_nationkey % 3 WHEN 0 THEN 'asc' WHEN 1 THEN 'desc' ELSE '' END AS "order"
  FROM supplier JOIN part ON s_suppkey = p_partkey)
"""

# The filters of a ``browse`` row b against a card row c.
SQL_BROWSE_FILTER = """
(NOT b.legendary OR contains(c.type_line, 'Legendary'))
AND contains(lower(c.type_line), lower(trim(b.type_filter)))
AND len(list_filter(b.wanted, lambda w: NOT list_contains(coalesce(c.colors, []), w))) = 0
AND (b.cmc_min < 0 OR trunc(coalesce(c.cmc, 0)) >= b.cmc_min)
AND (b.cmc_max IS NULL OR trunc(coalesce(c.cmc, 0)) <= b.cmc_max)
"""


def with_ctes(*parts: str) -> str:
    """A WITH clause from several definition lists, ready for the final SELECT."""
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
