"""The refined neighbour graph against the exact one."""

import numpy as np
import pyarrow as pa
import pytest
from likeness.operators import refine
from likeness.operators.neighbours import neighbours_of_all, recall
from likeness.plans import tables as V
from pyspark.sql import functions as F


@pytest.mark.parametrize("view", [V.vectors, V.grouped_vectors])
def test_recall_on_the_given_vectors(spark, view):
    vectors = view(spark, "/root/testdata/sf0.01")
    found = refine.neighbour_graph(vectors, 10)
    facts = recall(found, neighbours_of_all(vectors, 10)).head()
    assert facts["exact_hits"] == 5000 and facts["recall"] >= 0.93


def test_rounds_end_by_themselves_and_compare_few_pairs(spark):
    pick = np.random.default_rng(1)
    rows = pick.normal(size=(60, 8))[pick.integers(0, 60, 6000)] + 0.4 * pick.normal(size=(6000, 8))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id long, vector array<double>")
    graph = refine.refined(vectors, 5)
    assert 1 < len(graph.changes) < refine.ROUNDS and graph.changes[-1] <= refine.STILL
    assert list(graph.changes) == sorted(graph.changes, reverse=True)
    lists = graph.lists
    assert lists.groupBy("id").count().agg(F.max("count"), F.min("count")).head() == (13, 13)
    assert lists.filter("id = other").count() == 0 and lists.distinct().count() == lists.count()
    found = refine.first_per_group(lists, ["id"], ["distance", "other"], 5)
    found = found.select(F.col("id").alias("query_id"), F.col("other").alias("id"))
    assert recall(found, neighbours_of_all(vectors, 5)).head()["recall"] >= 0.95


def test_a_hub_brings_together_a_bounded_number_of_rows(spark):
    lists = spark.range(1, 2000).selectExpr("id", "0L AS other", "0.5D AS distance", "id % 2 = 0 AS fresh")
    got = refine.brought_together(lists, 10, 1).groupBy("at").count().collect()
    assert {r["at"]: r["count"] for r in got}[0] == 20 and len(got) == 2000


def test_groups_over_batches_are_compared_whole():
    rows = np.random.default_rng(2).normal(size=(30, 4))
    at = np.repeat([1, 2, 5, 9], [3, 12, 1, 14])
    batch = pa.record_batch(
        [
            pa.array(at), pa.array(np.arange(30)), pa.array([i % 3 == 0 for i in range(30)]),
            pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(np.full(30, np.inf)),
        ],
        names=["at", "id", "fresh", "packed", "bound"],
    )
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = {
        (a, b): round(1 - float(unit[a] @ unit[b]), 9)
        for a in range(30) for b in range(30)
        if a != b and at[a] == at[b] and (a % 3 == 0 or b % 3 == 0)
    }
    for size in (1, 4, 5, 30):
        parts = [batch.slice(i, size) for i in range(0, 30, size)]
        got = [t for out in refine.met(iter(parts), "<f8") for t in zip(*(c.to_pylist() for c in out.columns))]
        assert {(a, b): round(d, 9) for a, b, d in got} == want and len(got) == len(want)


def test_few_rows_and_copies(spark):
    schema = "id string, vector array<float>"
    for n in (0, 1, 2, 3):
        vectors = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(n)], schema)
        got = refine.neighbour_graph(vectors, 2).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, neighbours_of_all(vectors, 2).collect()))
    same = spark.createDataFrame([(str(i), [1.0, 2.0]) for i in range(300)], schema)
    got = refine.neighbour_graph(same, 4)
    assert got.count() == 1200 and got.agg(F.max("distance")).head()[0] == 0.0


def test_vectors_that_can_be_held_are_not_moved(spark, monkeypatch):
    """The same lists, with only the numbers of the vectors in what is brought together."""
    data = [(str(i), [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(5).normal(size=(300, 8)))]
    vectors = spark.createDataFrame(data, "id string, vector array<float>")
    moved = []
    told = refine.met

    def watched(batches, *how):
        batches = list(batches)
        for batch in batches:
            assert ("packed" in batch.schema.names) == (how[2] is None)
        return told(iter(batches), *how)

    monkeypatch.setattr(refine, "met", watched)
    for held_bytes in (0, refine.HELD_BYTES):
        moved.append(sorted(map(tuple, refine.refined(vectors, 4, rounds=3, held_bytes=held_bytes).lists.collect())))
    assert moved[0] == moved[1] and len(moved[0]) == 300 * 10
