"""Work is dealt out in tasks and rows of bounded size, with the same results."""

from __future__ import annotations

from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from likeness.operators import browse, encode, filters, resolve


def test_names_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(resolve, "TASK_ROWS", 50)
    rows = [(i % 40, f" n{i % 7} ") for i in range(900)] + [(1, " one ")] * 300 + [(2, None), (None, "n1"), (3, " ")]
    named = spark.createDataFrame(rows, "query_id int, name string").repartition(8)
    dealt = resolve.in_tasks(resolve.clean_names(named), "query_id", "name", F.spark_partition_id())
    assert dealt.rdd.getNumPartitions() == 25
    # Rows of one name asked for again and again lie in several tasks.
    hot = dealt.filter("query_id = 1 AND name = 'one'").select(F.spark_partition_id()).distinct()
    assert hot.count() > 1
    wanted = Counter((q, n.strip()) for q, n in rows if n and n.strip())
    found = resolve.counted_names(named).collect()
    assert {(r["query_id"], r["name"]): r["n"] for r in found} == wanted and len(found) == len(wanted)


CARD = "id string, name string, cmc double, type_line string, colors array<string>"


def some_cards(spark):
    names = ["red ring", "red bolt", "blue ring", "blue bolt"]
    rows = [(str(i), names[i % 4], float(i % 3), "Artifact", ["W"]) for i in range(60)]
    return spark.createDataFrame([*rows, ("x", None, 1.0, "Artifact", None)], CARD)


def some_requests(spark):
    """Of one kind with other ids and directions, one id twice, no id, no pattern."""
    rows = [(i, ("ring", "RED", " blue*t\t", None)[i % 4], ("asc", "desc")[i % 2], "cmc") for i in range(40)]
    rows += [(50, "ring", "asc", "name"), (50, "ring", "asc", "name"), (None, "ring", "asc", "name")]
    own = [F.lit(False).alias("legendary"), F.lit("art").alias("type_filter"), F.lit("").alias("colors_filter")]
    own += [F.lit(1).alias("cmc_min"), F.lit(None).cast("int").alias("cmc_max")]
    asked = spark.createDataFrame(rows, "query_id int, q string, `order` string, sort string")
    return asked.select("*", *own)


PATTERNS = {"ring": ("red ring", "blue ring"), "RED": ("red ring", "red bolt"), " blue*t\t": ("blue bolt",)}


def test_a_search_without_limit_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(browse, "TILE_ROWS", 4)
    monkeypatch.setattr(browse, "TASK_ROWS", 20)
    cards, requests = some_cards(spark), some_requests(spark)
    found = browse.search(cards.select("id", "name"), requests)
    assert found.columns == ["query_id", "name", "id"]
    wanted = Counter(
        (r["query_id"], c["name"], c["id"])
        for r in requests.collect()
        for c in cards.collect()
        if c["name"] in PATTERNS.get(r["q"], ())
    )
    assert Counter(map(tuple, found.collect())) == wanted
    most = max(r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    assert most < found.count() / 4


def test_copies_for_tiles_are_made_in_many_tasks(spark, monkeypatch):
    """Also where both sides come in one task each; small sides stay where they are."""
    left = spark.range(300, numPartitions=1).select((F.col("id") % 3).alias("key"), F.col("id").alias("a"))
    right = spark.range(240, numPartitions=1).select((F.col("id") % 4).alias("key"), F.col("id").alias("b"))
    wanted = Counter((a % 3, a, b) for a in range(300) for b in range(240) if a % 3 == b % 4)

    def exchanges():
        joined = browse.joined_in_tiles(left, right, "key")
        assert Counter(map(tuple, joined.select("key", "a", "b").collect())) == wanted
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("RepartitionByExpression")

    monkeypatch.setattr(browse, "TILE_ROWS", 8)
    assert exchanges() == 0
    monkeypatch.setattr(browse, "TASK_ROWS", 200)
    assert exchanges() == 4


def test_requests_of_one_kind_are_listed_once(spark, monkeypatch):
    monkeypatch.setattr(browse, "TILE_ROWS", 4)
    placed = []
    inner = browse.places_in_request
    monkeypatch.setattr(
        browse, "places_in_request", lambda hits, **how: placed.append(hits.count()) or inner(hits, **how)
    )
    cards, requests = some_cards(spark), some_requests(spark)
    found = browse.search_listing(cards, requests).collect()
    # 30 requests of three kinds with 20, 20 and 10 cards of which two thirds pass.
    assert placed == [20 + 20 + 10]
    lists = {}
    for row in found:
        lists.setdefault(row["query_id"], []).append(row)
    assert set(lists) == {i for i in range(40) if i % 4 < 3} | {50}
    for r in requests.filter("query_id IS NOT NULL AND query_id < 50 AND q IS NOT NULL").collect():
        hits = [c for c in cards.collect() if c["name"] in PATTERNS[r["q"]] and c["cmc"] >= 1]
        hits = sorted(((c["cmc"], c["name"], c["id"]) for c in hits), reverse=r["order"] == "desc")
        given = sorted(lists[r["query_id"]], key=lambda x: x["position"])
        assert [(x["cmc"], x["name"], x["id"]) for x in given] == hits
        assert [x["position"] for x in given] == list(range(1, len(hits) + 1))
    # Two rows of one id are one list of all pairs of them, as before.
    assert sorted(x["position"] for x in lists[50]) == list(range(1, 4 * 20 + 1))


def test_a_listing_sorts_narrow_rows_by_columns(spark, monkeypatch):
    """Only the columns asked for, and those of the order, are sorted; keys and filters are worked
    out once for a row, and not for each pair of rows."""
    seen, inner = [], browse.position_in_group

    def watched(rows, group, *keys):
        seen.append((set(rows.columns), rows._jdf.queryExecution().optimizedPlan().toString(), keys))
        return inner(rows, group, *keys)

    monkeypatch.setattr("likeness.operators.ordering.position_in_group", watched)
    cards, requests = some_cards(spark), some_requests(spark).filter("query_id < 50")
    found = browse.search_listing(cards, requests, columns=["id"])
    assert found.columns == ["query_id", "id", "position"]
    columns, plan, keys = seen[0]
    assert columns == {"query_id", "sort", "sort_number", "id", "name", "cmc"}
    assert not any("CASE" in str(k) for k in keys)
    pairs = [line for line in plan.split("\n") if "own_type" in line and "wish_type" in line and "Filter" in line or "Join" in line]
    assert pairs and not any(word in line for line in pairs for word in ("trim", "split", "lower(type", "transform"))
    whole = browse.search_listing(cards, requests)
    assert whole.columns == ["query_id", "name", "id", "cmc", "type_line", "colors", "position"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select(*found.columns).collect()))


def test_wishes_are_what_the_filter_asks_for(spark):
    kinds = [None, "", "Legendary Creature", "legendary", "Artifact  CREATURE", "\u0130stanbul"]
    colors = [None, [], ["W"], [" w ", "u"], [None, "U"], ["W", "U", "w"]]
    values = [None, 0.0, 0.9, 2.0, -1.5]
    own = [(i, *x) for i, x in enumerate(product(kinds, colors, values))]
    cards = spark.createDataFrame(own, "id int, type_line string, colors array<string>, cmc double")
    flags, types, wanted = [None, True, False], [None, " \t", " CREATURE\u00a0", "i\u0307st"], [None, "", "w, u", ",", " U "]
    asked = [(i, *x) for i, x in enumerate(product(flags, types, wanted, [(None, None), (-1, 0), (0, 2), (2, None)]))]
    asked = [(*x[:-1], *x[-1]) for x in asked]
    own = "query_id int, legendary boolean, type_filter string, colors_filter string, cmc_min int, cmc_max int"
    requests = spark.createDataFrame(asked, own)
    pairs = requests.withColumns(filters.wishes()).crossJoin(cards.withColumns(filters.traits()))
    told = pairs.groupBy(filters.request_filter().alias("a"), filters.wishes_met().alias("b")).count().collect()
    assert {(r["a"], r["b"]) for r in told} == {(True, True), (False, False)}


def test_printings_are_shown_once_for_each_name(spark, monkeypatch):
    monkeypatch.setattr(browse, "TILE_ROWS", 4)
    monkeypatch.setattr(browse, "TASK_PRINTINGS", 100)
    more = [F.lit("s").alias("set"), F.col("id").alias("collector_number"), F.lit("r").alias("rarity")]
    more += [F.lit("").alias("image_normal"), F.lit('{"modern":"legal"}').alias("legalities")]
    cards = some_cards(spark).select("*", *more)
    pages = browse.card_pages(cards, cards.select("id"), None, lambda p: F.array_join(F.transform(p, lambda x: x["id"]), " "))
    pages = pages.collect()
    assert len(pages) == 61
    for page in pages:
        same = sorted((int(c["id"]) for c in pages if c["name"] == page["name"]), key=int) if page["name"] else None
        assert page["n_printings"] == (len(same) if same else None)
        assert page["printings"] == (" ".join(map(str, same)) if same else None)


def test_token_vectors_come_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0, -i / 3]) for i in range(50)], "token int, vector array<double>")
    tokens = spark.createDataFrame([(f"d{i % 9}", i * 7 % 60) for i in range(300)], "id string, token int")
    whole = {r["id"]: r["vector"] for r in encode.pooled_vectors(tokens, vectors, 3).collect()}
    monkeypatch.setattr(encode, "HELD_BYTES", 1000)
    parts = encode.pooled_vectors(tokens, vectors, 3).collect()
    assert len(parts) == len(whole) == 9
    for row in parts:
        assert row["vector"] == pytest.approx(whole[row["id"]])
        own = [t for i in range(300) if f"d{i % 9}" == row["id"] for t in [i * 7 % 60] if t < 50]
        mean = [sum(own), float(len(own)), -sum(own) / 3]
        size = sum(x * x for x in mean) ** 0.5
        assert row["vector"] == pytest.approx([x / size for x in mean])
