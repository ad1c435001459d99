"""Registered queries: filters, orders, pages, search and card pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from likeness.operators import browse, filters, ordering
from likeness.operators.resolve import clean_names, counted_names, name_matches, resolve_names
from likeness.plans import tables as V
from likeness.plans.registry import query
from likeness.session import fresh_dir
from likeness.sources.name_index import NameIndex
from likeness.sources.sorted_rows import SortedRows

_CARDS = V.with_ctes(V.SQL_CARDS)


@query(
    "p23_clamped_parameters",
    """
    SELECT o_orderkey, CASE WHEN k > 0 THEN k ELSE 10 END AS service_k,
      least(greatest(k * 100, 200), 500) AS browsing_k,
      CASE WHEN k * 20 BETWEEN 1 AND 100 THEN k * 20 ELSE 20 END AS page_limit
    FROM (SELECT o_orderkey, o_custkey % 11 - 2 AS k FROM orders)""",
)
def p23_clamped_parameters(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 11 - 2
    return orders.select(
        "o_orderkey",
        filters.service_k(k).alias("service_k"),
        filters.browsing_k(k * 100).alias("browsing_k"),
        filters.page_limit(k * 20).alias("page_limit"),
    )


@query(
    "f1_name_equals",
    _CARDS
    + """, asked AS (SELECT min(name) AS name FROM cards GROUP BY "set")
    SELECT id, name, "set" FROM cards WHERE name IN (SELECT name FROM asked)""",
)
def f1_name_equals(spark, sf_dir):
    cards = V.cards(spark, sf_dir)
    asked = cards.groupBy("set").agg(F.min("name").alias("name"))
    return browse.cards_by_name(cards, asked).select("id", "name", "set")


@query(
    "f2_name_contains",
    _CARDS
    + """SELECT id, name, contains(lower(name), lower('WIDGET')) AS plain,
      lower(name) LIKE '%l%wi_g%' AS wild, contains(lower(name), 'a.b') AS dotted FROM cards""",
)
def f2_name_contains(spark, sf_dir):
    name = F.col("name")
    return V.cards(spark, sf_dir).select(
        "id",
        "name",
        name_matches(name, F.lit("WIDGET")).alias("plain"),
        name_matches(name, F.lit("L*wi?g")).alias("wild"),
        name_matches(name, F.lit("a.b")).alias("dotted"),
    )


SQL_FOUND = """, ranked AS (
  SELECT b.query_id, c.*, count(*) OVER (PARTITION BY b.query_id) AS n_matches,
    row_number() OVER (PARTITION BY b.query_id ORDER BY c.name, c.id) AS place
  FROM browse b JOIN cards c
    ON lower(c.name) LIKE '%' || replace(lower(trim(b.q)), '*', '%') || '%')"""
SQL_SEARCH = V.with_ctes(V.SQL_CARDS, V.SQL_BROWSE_REQUESTS) + SQL_FOUND


@query("f2_search", SQL_SEARCH + "SELECT query_id, id, name FROM ranked")
def f2_search(spark, sf_dir):
    cards = V.cards(spark, sf_dir).select("id", "name")
    return browse.search(cards, V.browse_requests(spark, sf_dir)).select("query_id", "id", "name")


def stored_names(spark, sf_dir) -> NameIndex:
    """The cards' names in two steps; a third one delivers the first again."""
    index, cards = NameIndex(spark, fresh_dir(spark, "names")), V.cards(spark, sf_dir)
    odd = F.col("id").cast("bigint") % 2 == 1
    index.add(cards.filter(odd), "odd")
    index.add(cards.filter(~odd), "even")
    index.add(cards.filter(odd), "odd")
    return index


@query("f2_search_stored", SQL_SEARCH + "SELECT query_id, id, name FROM ranked")
def f2_search_stored(spark, sf_dir):
    """The same over a stored index of the names."""
    cards, index = V.cards(spark, sf_dir).select("id", "name"), stored_names(spark, sf_dir)
    found = browse.search(cards, V.browse_requests(spark, sf_dir), index=index)
    return found.select("query_id", "id", "name")


@query(
    "f2_search_first", SQL_SEARCH + "SELECT query_id, id, name, n_matches FROM ranked WHERE place <= 40"
)
def f2_search_first(spark, sf_dir):
    cards = V.cards(spark, sf_dir).select("id", "name")
    found = browse.search(cards, V.browse_requests(spark, sf_dir), limit=40)
    return found.select("query_id", "id", "name", "n_matches")


def _listing_sql(limit: str) -> str:
    return (
        SQL_SEARCH
        + f""", kept AS (
      SELECT c.query_id, c.id, c.name, c.cmc, b.sort, b."order" FROM ranked c
      JOIN browse b ON c.query_id = b.query_id WHERE {limit} AND {V.SQL_BROWSE_FILTER}),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
          CASE WHEN sort = 'cmc' THEN coalesce(cmc, 0) END, name, id) AS up,
        count(*) OVER (PARTITION BY query_id) AS n FROM kept)
    SELECT query_id, id, name, cmc,
      CAST(CASE WHEN "order" IN ('', 'desc') THEN n + 1 - up ELSE up END AS INTEGER) AS position
    FROM placed"""
    )


def _listing(spark, sf_dir, limit):
    cards, requests = V.cards(spark, sf_dir), V.browse_requests(spark, sf_dir)
    shown = ["id", "name", "cmc"]
    return browse.search_listing(cards, requests, limit, shown).select("query_id", *shown, "position")


@query("f2_search_listing", _listing_sql("true"))
def f2_search_listing(spark, sf_dir):
    return _listing(spark, sf_dir, None)


@query("f2_search_listing_first", _listing_sql("place <= 40"))
def f2_search_listing_first(spark, sf_dir):
    return _listing(spark, sf_dir, 40)


@query(
    "f3_id_equals",
    _CARDS
    + """SELECT id, name, type_line FROM cards
    WHERE id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')""",
)
def f3_id_equals(spark, sf_dir):
    lines = V.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    ids = lines.select(F.col("l_partkey").cast("string").alias("id")).distinct()
    return V.cards(spark, sf_dir).join(ids, "id", "left_semi").select("id", "name", "type_line")


@query(
    "f4_legendary",
    _CARDS + "SELECT id, type_line FROM cards WHERE contains(type_line, 'Legendary')",
)
def f4_legendary(spark, sf_dir):
    cards = V.cards(spark, sf_dir)
    return cards.filter(filters.is_legendary(F.col("type_line"))).select("id", "type_line")


@query(
    "f5_type_contains",
    _CARDS + "SELECT id, type_line FROM cards WHERE contains(lower(type_line), 'creature')",
)
def f5_type_contains(spark, sf_dir):
    wanted = filters.type_contains(F.col("type_line"), F.lit(" CREATURE "))
    return V.cards(spark, sf_dir).filter(wanted).select("id", "type_line")


@query(
    "f6_all_colors",
    _CARDS
    + """SELECT id, coalesce(list_contains(colors, 'W') AND list_contains(colors, 'U'), false)
      AS white_blue, true AS blank FROM cards""",
)
def f6_all_colors(spark, sf_dir):
    colors = F.col("colors")
    return V.cards(spark, sf_dir).select(
        "id",
        filters.has_all_colors(colors, F.lit("w, u")).alias("white_blue"),
        filters.has_all_colors(colors, F.lit(" , ")).alias("blank"),
    )


@query(
    "f7_mana_value_range",
    _CARDS
    + """SELECT id, trunc(coalesce(cmc, 0)) BETWEEN 1 AND 3 AS both_ends,
      trunc(coalesce(cmc, 0)) <= 2 AS upper_end, true AS off FROM cards""",
)
def f7_mana_value_range(spark, sf_dir):
    cmc, off = F.col("cmc"), F.lit(-1)
    return V.cards(spark, sf_dir).select(
        "id",
        filters.mana_value_between(cmc, F.lit(1), F.lit(3)).alias("both_ends"),
        filters.mana_value_between(cmc, F.lit(None).cast("int"), F.lit(2)).alias("upper_end"),
        filters.mana_value_between(cmc, off, off).alias("off"),
    )


@query(
    "f9_clean_names",
    V.with_ctes(V.SQL_ORDER_REQUESTS)
    + "SELECT query_id, name, count(*) AS n FROM named WHERE name <> '' GROUP BY query_id, name",
)
def f9_clean_names(spark, sf_dir):
    _, named = V.order_requests(spark, sf_dir)
    return counted_names(named)


def _sorted_sql(key: str, up: bool) -> str:
    way = "ASC" if up else "DESC"
    return f"row_number() OVER (ORDER BY {key} {way}, name {way}, id {way}) - 1"


@query(
    "o1_sort_hits",
    _CARDS
    + f"""SELECT id, name, cmc, {_sorted_sql('coalesce(cmc, 0)', False)} AS by_cmc_down,
      {_sorted_sql('name', True)} AS by_name_up FROM cards""",
)
def o1_sort_hits(spark, sf_dir):
    cards = V.cards(spark, sf_dir).select("id", "name", "cmc")
    down = [F.coalesce("cmc", F.lit(0.0)).desc(), F.desc("name"), F.desc("id")]
    placed = ordering.with_position(cards, *down).withColumnRenamed("position", "by_cmc_down")
    return ordering.with_position(placed, "name", "id").withColumnRenamed("position", "by_name_up")


@query(
    "o2_sort_printings",
    _CARDS
    + """, keyed AS (SELECT *, CASE WHEN regexp_full_match(collector_number, '[+-]?[0-9]+')
      THEN CAST(collector_number AS BIGINT) END AS number FROM cards)
    SELECT id, "set", collector_number, row_number() OVER (
      ORDER BY "set", number NULLS LAST, collector_number, id) - 1 AS position FROM keyed""",
)
def o2_sort_printings(spark, sf_dir):
    cards = V.cards(spark, sf_dir).select("id", "set", "collector_number")
    return ordering.with_position(cards, *ordering.collector_keys())


@query(
    "o3_limit_per_request",
    _CARDS
    + """SELECT name, id FROM (SELECT name, id,
      row_number() OVER (PARTITION BY name ORDER BY id) AS place FROM cards) WHERE place <= 20""",
)
def o3_limit_per_request(spark, sf_dir):
    return browse.first_per_name(V.cards(spark, sf_dir).select("name", "id"), 20)


@query(
    "o4_page",
    _CARDS
    + """SELECT id, name, (SELECT count(*) FROM cards) > 60 AS has_next, true AS has_prev,
      20 AS prev_offset, 60 AS next_offset
    FROM (SELECT id, name FROM cards ORDER BY name, id LIMIT 20 OFFSET 40)""",
)
def o4_page(spark, sf_dir):
    return ordering.page(V.cards(spark, sf_dir).select("id", "name"), offset=40, limit=20)


@query(
    "o4_pages",
    _CARDS
    + """, placed AS (SELECT id, name, row_number() OVER (ORDER BY name, id) - 1 AS position,
      count(*) OVER () AS n FROM cards)
    SELECT id, name, position, position // 20 * 20 AS "offset", position >= 20 AS has_prev,
      position // 20 * 20 + 20 < n AS has_next,
      greatest(position // 20 * 20 - 20, 0) AS prev_offset,
      position // 20 * 20 + 20 AS next_offset FROM placed""",
)
def o4_pages(spark, sf_dir):
    return ordering.pages(V.cards(spark, sf_dir).select("id", "name"), 20)


def _stored_pages(spark, sf_dir):
    cards = V.cards(spark, sf_dir).select("id", "name")
    stored = SortedRows(spark, fresh_dir(spark, "sorted"))
    stored.write(cards, run_rows=300)
    return cards, stored


@query(
    "o4_stored_pages",
    _CARDS
    + """, placed AS (SELECT id, name, row_number() OVER (ORDER BY name, id) - 1 AS position,
      count(*) OVER () AS n FROM cards),
    depths AS (SELECT unnest([1, 50, 99]) AS percent)
    SELECT percent, id, name, true AS has_prev, n * percent // 100 + 20 < n AS has_next
    FROM placed, depths WHERE position >= n * percent // 100 AND position < n * percent // 100 + 20""",
)
def o4_stored_pages(spark, sf_dir):
    """Pages at three depths of rows that are stored in sorted runs."""
    cards, stored = _stored_pages(spark, sf_dir)
    n, found = cards.count(), None
    for percent in (1, 50, 99):
        page = stored.page(n * percent // 100, 20).select(
            F.lit(percent).alias("percent"), "id", "name", "has_prev", "has_next"
        )
        found = page if found is None else found.unionByName(page)
    return found


@query(
    "o4_page_after",
    _CARDS
    + """, seen AS (SELECT name, id FROM cards ORDER BY name, id LIMIT 1 OFFSET 59)
    SELECT c.id, c.name FROM cards c, seen s
    WHERE c.name > s.name OR (c.name = s.name AND c.id > s.id)
    ORDER BY c.name, c.id LIMIT 20""",
)
def o4_page_after(spark, sf_dir):
    cards = V.cards(spark, sf_dir).select("id", "name")
    last = cards.orderBy("name", "id").offset(59).limit(1).head()
    return ordering.page_after(cards, last["name"], last["id"], 20)


@query(
    "o5_sample_legendary",
    _CARDS
    + """SELECT id, name, type_line FROM cards
    WHERE contains(type_line, 'Legendary') AND contains(type_line, 'Creature')
    ORDER BY sha256(id || ':7'), id LIMIT 24""",
)
def o5_sample_legendary(spark, sf_dir):
    picks = ordering.sample_legendary(V.cards(spark, sf_dir), 24, seed="7")
    return picks.select("id", "name", "type_line")


@query(
    "o6_window_of_rows",
    """
    SELECT doc_id, source, position FROM (
      SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
    WHERE position >= 100""",
)
def o6_window_of_rows(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", "source")
    return ordering.window_of_rows(docs, 100, 0, "doc_id")


@query(
    "a2_count_cards",
    _CARDS + "SELECT type_line, count(*) AS n FROM cards GROUP BY type_line",
)
def a2_count_cards(spark, sf_dir):
    return V.cards(spark, sf_dir).groupBy("type_line").agg(F.count("*").alias("n"))


SQL_PRINTINGS = """
keyed AS (SELECT *, CASE WHEN regexp_full_match(collector_number, '[+-]?[0-9]+')
  THEN CAST(collector_number AS BIGINT) END AS number FROM cards),
prints AS (SELECT name, id, "set", collector_number, rarity, image_normal,
  CAST(row_number() OVER (PARTITION BY name
    ORDER BY "set", number NULLS LAST, collector_number, id) AS INTEGER) AS position,
  count(*) OVER (PARTITION BY name) AS n_printings FROM keyed)
"""


@query(
    "a3_printings", V.with_ctes(V.SQL_CARDS, SQL_PRINTINGS) + "SELECT * EXCLUDE n_printings FROM prints"
)
def a3_printings(spark, sf_dir):
    return browse.printings(V.cards(spark, sf_dir))


@query(
    "a3_printings_first",
    V.with_ctes(V.SQL_CARDS, SQL_PRINTINGS) + "SELECT * FROM prints WHERE position <= 10",
)
def a3_printings_first(spark, sf_dir):
    return browse.printings(V.cards(spark, sf_dir), limit=10)


def _pages_sql(limit: str) -> str:
    return (
        V.with_ctes(V.SQL_CARDS, SQL_PRINTINGS)
        + f""", lists AS (SELECT name, max(n_printings) AS n,
        string_agg("set" || '#' || collector_number, ' ' ORDER BY position) AS printings
      FROM prints WHERE {limit} GROUP BY name)
    SELECT c.id, c.name, c.mana_cost, c.cmc, c.type_line, c.oracle_text, c.power, c.toughness,
      c."set", c.collector_number, c.rarity, c.image_normal,
      CASE WHEN starts_with(c.legalities, '{{')
        THEN json_extract_string(c.legalities, '$.modern') END AS modern,
      CAST(l.n AS INTEGER) AS n_printings, l.printings
    FROM cards c JOIN lists l ON c.name = l.name
    WHERE c.id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem)"""
    )


def _pages(spark, sf_dir, limit):
    lines = V.table(spark, sf_dir, "lineitem")
    ids = lines.select(F.col("l_partkey").cast("string").alias("id"))


    def shown(printings):
        label = F.transform(printings, lambda p: F.concat(p["set"], F.lit("#"), p["collector_number"]))
        return F.array_join(label, " ")

    return browse.card_pages(V.cards(spark, sf_dir), ids, limit, shown).select(
        *["id", "name", "mana_cost", "cmc", "type_line", "oracle_text", "power", "toughness"],
        *["set", "collector_number", "rarity", "image_normal"],
        F.try_element_at("legality_map", F.lit("modern")).alias("modern"),
        "n_printings",
        "printings",
    )


@query("a4_card_pages", _pages_sql("true"))
def a4_card_pages(spark, sf_dir):
    return _pages(spark, sf_dir, None)


@query("a4_card_pages_first", _pages_sql("position <= 10"))
def a4_card_pages_first(spark, sf_dir):
    return _pages(spark, sf_dir, 10)


def sql_resolved() -> str:
    return V.with_ctes(V.SQL_CARDS, V.SQL_VECTORS, V.SQL_ORDER_REQUESTS, V.SQL_RESOLVED) + (
        "SELECT name, match_kind, matched_name, id FROM resolved"
    )


@query("v1_resolve_stored", sql_resolved())
def v1_resolve_stored(spark, sf_dir):
    """Names resolved over a stored index of the catalogue's names."""
    _, named = V.order_requests(spark, sf_dir)
    index = stored_names(spark, sf_dir)
    return resolve_names(clean_names(named), V.cards(spark, sf_dir).select("name", "id"), index)
