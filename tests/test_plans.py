"""Every registered query against its SQL, and what their plans must not hold."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    compare = pytest.importorskip("compare")
    pytest.importorskip("sys").path.append("/opt/oracle")
    pytest.importorskip("duckdb")
    return compare.oracle(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_agrees_with_sql(spark, con, name):
    from compare import compare

    assert compare(spark, con, SF_DIR, name, queries()[name], oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    ["v1_resolve_names", "v7_similar", "f2_search", "v8_browse_similar", "v10_neighbours_of_all_tiles"],
)
def test_no_cross_joins(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["a3_printings_first", "v5b_exact_topk_one_pass", "f2_search_first"])
def test_groups_are_limited_on_the_map_side(spark, name):
    plan = queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_tags_run_in_generated_code(spark):
    plan = queries()["p10_p15_corpus_tags"](spark, SF_DIR)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.startswith("*(1) Project")


def test_scans_read_only_what_they_need(spark):
    plan = queries()["p7_legality_rows"](spark, SF_DIR)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in text


def test_the_assignment_is_computed_once(spark):
    """A search in cells reads it several times, each time from where it was stored."""
    plan = queries()["v5b_exact_topk_tiles"](spark, SF_DIR)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in text and "embeddings.parquet" not in text


def test_unlimited_listings_have_no_window(spark):
    """Nor have printings: a request that matches nearly all, or a name that a third of all
    cards have, is sorted over all tasks."""
    from likeness.operators import browse
    from likeness.plans import tables as V

    sf = "/root/testdata/sf0.001"
    cards, requests = V.cards(spark, sf), V.browse_requests(spark, sf)
    everything = requests.withColumn("q", F.lit("*"))
    for found in (browse.search_listing(cards, everything), browse.printings(cards.withColumn("name", F.lit("x")))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    placed = browse.printings(cards.withColumn("name", F.lit("x"))).select("position").collect()
    assert sorted(r["position"] for r in placed) == list(range(1, cards.count() + 1))
