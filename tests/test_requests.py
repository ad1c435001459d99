import pytest
from likeness.operators import browse, ordering, resolve, similar
from pyspark.sql import functions as F

NAMES = {
    "1": "Red Fox", "2": "Red Fox", "3": "Redwood", "4": "Blue Jay", "5": "Jay", "6": "a.b*c",
    "7": "Old Red Barn",
}
VECTORS = {
    "1": [1.0, 0.0], "2": [0.9, 0.1], "3": [0.0, 1.0], "4": [-1.0, 0.0], "5": [0.7, 0.7],
    "7": [0.6, 0.8],
}


@pytest.fixture(scope="module")
def cards(spark):
    rows = [
        (i, name, "Legendary Creature" if i in "14" else "Artifact", "{1}", f"text {i}", ["W"],
         f"img{i}", float(i), "set", i, "rare", "")
        for i, name in NAMES.items()
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, type_line string, mana_cost string, oracle_text string, "
        "colors array<string>, image_normal string, cmc double, set string, "
        "collector_number string, rarity string, legalities string",
    ).cache()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(VECTORS.items()), "id string, vector array<float>").cache()


def resolved(spark, cards, *names):
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    rows = resolve.resolve_names(asked, cards.select("id", "name")).collect()
    return {r["name"]: (r["match_kind"], r["id"]) for r in rows}


@pytest.mark.parametrize("few", [0, 100])
def test_names(spark, cards, monkeypatch, few):
    """Both ways of matching: by constants, and by grams."""
    monkeypatch.setattr(resolve, "FEW_PATTERNS", few)
    got = resolved(
        spark, cards, "Red Fox", "red", "JAY", "Jay", "ed*x", "r?d w", "r?dw", "no", "a.b*c", ".",
        "*", "?????????????", "x" * 30, "[", "R", "edwoo", "wood*", "*dwoo?",
    )
    assert got == {
        "Red Fox": ("exact", "1"),
        "red": ("like", "7"),  # Old Red Barn comes before Red Fox
        "JAY": ("like", "4"),
        "Jay": ("exact", "5"),
        "ed*x": ("like", "1"),
        "r?d w": ("none", None),
        "r?dw": ("like", "3"),
        "no": ("none", None),
        "a.b*c": ("exact", "6"),
        ".": ("like", "6"),
        "*": ("like", "4"),
        "?????????????": ("none", None),
        "x" * 30: ("none", None),
        "[": ("none", None),
        "R": ("like", "7"),
        "edwoo": ("like", "3"),
        "wood*": ("like", "3"),
        "*dwoo?": ("like", "3"),
    }


def test_all_names_exact(spark, cards):
    assert resolved(spark, cards, "Jay") == {"Jay": ("exact", "5")}


def test_ids(spark, cards):
    ids = spark.createDataFrame([("5",), ("nine",), ("5",)], "id string")
    rows = resolve.resolve_ids(ids, cards).collect()
    assert sorted(map(tuple, rows)) == [("5", "5"), ("nine", None)]


REQUESTS = [
    (1, ["Red Fox"], 3),
    (2, [" Red Fox ", "", "Red Fox", "Jay"], 0),
    (3, ["Red Fox", "unknown"], 5),
    (4, ["  ", ""], 5),
    (5, [], 5),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(REQUESTS, "query_id int, names array<string>, k int")


def test_requests(cards, requests):
    members, status = resolve.resolve_requests(requests, cards.select("id", "name"))
    assert dict(map(tuple, status.collect())) == {
        1: "ok", 2: "ok", 3: "not_found", 4: "empty", 5: "empty",
    }
    assert sorted(map(tuple, members.collect())) == [(1, "1", 1), (2, "1", 2), (2, "5", 1)]


def test_similar_leaves_out_inputs_after_the_search(cards, vectors, requests):
    hits, _ = similar.similar(requests, cards, vectors)
    found = {}
    for r in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["id"])
    # Three nearest to item 1 are 1, 2 and 5; the input itself is dropped.
    assert found[1] == ["2", "5"]
    # k 0 means 10, so all vectors are hits but the two inputs.
    assert sorted(found[2]) == ["2", "3", "4", "7"]
    assert set(found) == {1, 2}


def test_similar_refilled(cards, vectors, requests):
    hits, _ = similar.similar(requests, cards, vectors, refill=True)
    own = sorted((r["rank"], r["id"]) for r in hits.collect() if r["query_id"] == 1)
    assert own == [(1, "2"), (2, "5"), (3, "7")]


def test_similar_with_filter_before_the_search(cards, vectors, requests):
    hits, _ = similar.similar(requests, cards, vectors, where=F.col("type_line") == "Artifact")
    own = sorted((r["rank"], r["id"]) for r in hits.collect() if r["query_id"] == 1)
    assert own == [(1, "2"), (2, "5"), (3, "7")]


BROWSE = """query_id int, id string, name string, q string, k int, legendary boolean,
type_filter string, colors_filter string, cmc_min int, cmc_max int, sort string, order string"""


def test_browse_similar(spark, cards, vectors):
    rows = [
        (1, "1", "Jay", "", None, False, "", "", -1, -1, "", ""),
        (2, "", "Jay", "", 9, True, "", "", -1, -1, "name", "asc"),
        (3, "", "Jay", "", 9, False, "art", "w", 2, 5, "cmc", "asc"),
        (4, "", "nothing", "", 9, False, "", "", -1, -1, "", ""),
    ]
    asked = spark.createDataFrame(rows, BROWSE)
    listed = similar.browse_similar(asked, cards, vectors).collect()
    lists = {}
    for r in sorted(listed, key=lambda r: (r["query_id"], r["position"])):
        lists.setdefault(r["query_id"], []).append(r["id"])
    assert lists == {1: ["1", "2", "5", "7", "3", "4"], 2: ["4", "1"], 3: ["2", "3", "5"]}


def test_search_listing(spark, cards):
    rows = [
        (1, "", "", " red ", None, False, "", "", -1, -1, "", ""),
        (2, "", "", "RED", None, False, "", "", -1, -1, "cmc", "asc"),
        (3, "", "", "red", None, True, "", "", -1, -1, "price", "asc"),
        (4, "", "", "  ", None, False, "", "", -1, -1, "", ""),
    ]
    listed = browse.search_listing(cards, spark.createDataFrame(rows, BROWSE)).collect()
    lists = {}
    for r in sorted(listed, key=lambda r: (r["query_id"], r["position"])):
        lists.setdefault(r["query_id"], []).append(r["id"])
    assert lists == {1: ["3", "2", "1", "7"], 2: ["1", "2", "3", "7"], 3: ["1"]}


def test_search_limit_comes_before_filters(spark, cards):
    row = (1, "", "", "red", None, True, "", "", -1, -1, "", "")
    asked = spark.createDataFrame([row], BROWSE)
    assert browse.search_listing(cards, asked, limit=1).count() == 0
    assert sorted(r["id"] for r in browse.search(cards, asked, limit=3).collect()) == ["1", "2", "7"]
    assert browse.search(cards, asked, limit=None).count() == 4


def test_card_pages(spark, cards):
    ids = spark.createDataFrame([("1",), ("6",), ("none",)], "id string")
    pages = {r["id"]: r for r in browse.card_pages(cards, ids).collect()}
    assert sorted(pages) == ["1", "6"]
    assert [p["id"] for p in pages["1"]["printings"]] == ["1", "2"]
    assert pages["6"]["legality_map"] == {}


def test_sort_hits(cards):
    def ids(**how):
        rows = cards.withColumn("similarity", -F.col("cmc"))
        return "".join(r["id"] for r in ordering.sort_hits(rows, **how).collect())

    assert ids() == ids(key="name", order="desc") == "6321754"
    assert ids(order="asc") == ids(key="unknown", order="up") == "4571236"
    assert ids(key="cmc", order="asc") == "1234567"
    assert ids(similar=True) == "1234567"


def test_printings_order(spark):
    numbers = ["10", "9", "2a", "+5", ""]
    rows = [(n, "s", n, "n") for n in numbers] + [("z", "a", "7", "n")]
    df = spark.createDataFrame(rows, "id string, set string, collector_number string, name string")
    got = [r["id"] for r in ordering.sort_printings(df).collect()]
    assert got == ["z", "+5", "9", "10", "", "2a"]


@pytest.mark.parametrize("keys", [1, 500])
def test_positions(spark, keys):
    """Also when all rows have the same first key."""
    rows = spark.range(500).select(
        (F.col("id") * 7919 % 500).alias("id"), (F.col("id") % keys).alias("name")
    )
    placed = ordering.with_position(rows.repartition(7), "name", "id").collect()
    assert [r["position"] for r in sorted(placed, key=lambda r: (r["name"], r["id"]))] == list(range(500))
    window = ordering.window_of_rows(rows, 490, 20, "name", "id")
    assert window.count() == 10
    assert ordering.window_of_rows(rows.limit(0), 0, 5, "name", "id").count() == 0


@pytest.mark.parametrize("skip", [100_000, 3, 0])
def test_pages(spark, monkeypatch, skip):
    monkeypatch.setattr(ordering, "SKIP_ROWS", skip)
    rows = spark.range(45).select(F.col("id"), F.format_string("%03d", "id").alias("name"))
    page = ordering.page(rows, 20, 20).collect()
    assert sorted(r["id"] for r in page) == list(range(20, 40))
    assert {(r["has_prev"], r["has_next"], r["prev_offset"], r["next_offset"]) for r in page} == {
        (True, True, 0, 40)
    }
    last = ordering.page(rows, 40, 20).collect()
    assert len(last) == 5 and not last[0]["has_next"]
    behind = ordering.page_after(rows, "039", 39, 3).collect()
    assert [r["id"] for r in behind] == [40, 41, 42]


def test_sample(cards):
    first = [r["id"] for r in ordering.sample_legendary(cards, 5, "a").collect()]
    assert sorted(first) == ["1", "4"]
    assert first == [r["id"] for r in ordering.sample_legendary(cards, 5, "a").collect()]
    assert ordering.sample_legendary(cards, 5, name_pool=400).count() == 0


def test_a_deep_page_of_many_rows(spark, monkeypatch):
    """Rows are counted between keys, and only a range near the page is sorted; one name
    has half of all rows, and some rows have none."""
    monkeypatch.setattr(ordering, "SKIP_ROWS", 100)
    name = F.when(F.col("id") % 2 == 0, "same").when(F.col("id") % 501 != 0, F.md5(F.col("id").cast("string")))
    rows = spark.range(6000).select("id", name.alias("name"))
    want = [r["id"] for r in rows.orderBy("name", "id").collect()]
    for offset in (0, 7, 2990, 5985):
        near, skipped = ordering.near_page(rows, offset, 20)
        assert near.count() <= 1500 and skipped < 1500
        got = ordering.page(rows, offset, 20).orderBy("name", "id").collect()
        assert [r["id"] for r in got] == want[offset : offset + 20]
        assert {r["has_next"] for r in got} == {offset + 20 < 6000}


def test_patterns_of_wildcards_alone(spark):
    from likeness.operators.resolve import resolve_names

    cards = spark.createDataFrame([("bb", "2"), ("a", "1"), ("cccc", "3"), ("bb", "0")], "name string, id string")
    asked = spark.createDataFrame([(p,) for p in ("*", "?", "??", "?*?*?", "*****?????", "b*")], "name string")
    got = {r["name"]: (r["match_kind"], r["id"]) for r in resolve_names(asked, cards).collect()}
    assert got == {
        "*": ("like", "1"), "?": ("like", "1"), "??": ("like", "0"), "?*?*?": ("like", "3"),
        "*****?????": ("none", None), "b*": ("like", "0"),
    }


def test_intermediate_results_can_be_discarded(spark):
    from likeness import session

    path = session.fresh_dir(spark, "some")
    spark.range(3).write.parquet(path)
    assert session.path_exists(spark, path) and path.startswith(session.own_dir(spark))
    kept = session.delete_path(spark, path)
    assert kept and not session.path_exists(spark, path)


@pytest.mark.parametrize("how", [{}, {"refill": True, "strategy": "cells", "n_cells": 2}])
def test_requests_of_the_same_items_are_searched_once(spark, cards, vectors, monkeypatch, how):
    """Each takes its own number of hits; ids that repeat are still ranked together."""
    rows = [(i, ["Jay", "Redwood"][: 1 + i % 2], 1 + i % 3) for i in range(40)]
    asked = spark.createDataFrame(rows, "query_id int, names array<string>, k int")
    searched, nearest, same = [], similar.nearest, similar.same_members

    def watched(queries, *args, **options):
        searched.append(queries.count())
        return nearest(queries, *args, **options)

    def hits(requests):
        found = similar.similar(requests, cards, vectors, **how)[0].collect()
        return sorted((r["query_id"], r["rank"], r["id"]) for r in found)

    monkeypatch.setattr(similar, "nearest", watched)
    once, twice = hits(asked), hits(asked.unionByName(asked.filter("query_id = 1")))
    monkeypatch.setattr(similar, "same_members", lambda m: same(m).withColumn("like", F.col("query_id")))
    assert once == hits(asked) and len({q for q, _, _ in once}) >= 30
    assert [h for h in twice if h[0] != 1] == [h for h in once if h[0] != 1]
    assert searched == [2, 2, 2, 40]


def test_the_same_item_is_browsed_once(spark, cards, vectors, monkeypatch):
    rows = [(i, "1" if i % 2 else "", "Jay", "", None, False, "", "", -1, -1, "", "asc") for i in range(30)]
    searched, nearest = [], similar.nearest

    def watched(queries, *args, **options):
        searched.append(queries.count())
        return nearest(queries, *args, **options)

    monkeypatch.setattr(similar, "nearest", watched)
    listed = similar.browse_similar(spark.createDataFrame(rows, BROWSE), cards, vectors).collect()
    assert searched[0] <= 2 and len({r["query_id"] for r in listed}) == 30
    one = sorted((r["position"], r["id"]) for r in listed if r["query_id"] == 1)
    assert len(one) == 6 and all(one == sorted((r["position"], r["id"]) for r in listed if r["query_id"] == i) for i in (3, 29))
