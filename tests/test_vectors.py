import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from likeness.functions import vectors as X
from likeness.operators import blocks, cells
from likeness.operators.centroid import centroids, weighted_mean
from likeness.operators.neighbours import (
    nearest,
    nearest_in_cells,
    neighbours_of_all,
    recall,
)
from pyspark.sql import functions as F

WAYS = [
    {"strategy": "hold_vectors"},
    {"strategy": "hold_queries", "block_rows": 50},
    {"strategy": "cells", "block_rows": 40, "n_cells": 5},
]


def frame(spark, rows, name):
    data = [(key, [float(x) for x in v]) for key, v in rows]
    return spark.createDataFrame(data, f"{name} string, vector array<float>").repartition(4)


def brute(queries, vectors, k, exclude_self=False):
    """All distances one by one, ties to the smaller id."""
    found = []
    for qid, q in queries:
        q = np.float32(q).astype(float)
        scored = []
        for vid, v in vectors:
            v = np.float32(v).astype(float)
            size = np.linalg.norm(q) * np.linalg.norm(v)
            distance = 1.0 if size == 0 else 1 - float(q @ v) / size
            if not (exclude_self and qid == vid):
                scored.append((round(distance, 9) + 0.0, vid))
        found += [(qid, i + 1, vid) for i, (_, vid) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def got(hits):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in hits.collect())


@pytest.fixture(scope="module")
def points():
    """Clusters, of which one is copies of a single vector holding a third of all rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(f"v{i:03}", centres[i % 6] + 0.1 * rng.normal(size=12)) for i in range(180)]
    rows += [(f"copy{i:03}", centres[0]) for i in range(90)]
    return rows + [("zero", np.zeros(12))]


@pytest.mark.parametrize("way", WAYS, ids=lambda w: w["strategy"])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_nearest_matches_brute_force(spark, points, way, k):
    rng = np.random.default_rng(6)
    queries = [(f"q{i}", rng.normal(size=12)) for i in range(8)]
    queries += [("on-copies", points[-2][1]), ("zero-query", np.zeros(12))]
    hits = nearest(frame(spark, queries, "query_id"), frame(spark, points, "id"), k, **way)
    assert got(hits) == brute(queries, points, k)


@pytest.mark.parametrize("way", WAYS, ids=lambda w: w["strategy"])
def test_neighbours_of_all(spark, points, way):
    hits = neighbours_of_all(frame(spark, points, "id"), 5, **way)
    assert got(hits) == brute(points, points, 5, exclude_self=True)


@pytest.mark.parametrize("way", WAYS, ids=lambda w: w["strategy"])
def test_own_k_per_query(spark, points, way):
    queries = [("a", points[0][1]), ("b", points[1][1])]
    frame_k = frame(spark, queries, "query_id").withColumn(
        "k", F.when(F.col("query_id") == "a", 2).otherwise(9)
    )
    hits = got(nearest(frame_k, frame(spark, points, "id"), **way))
    want = [h for h in brute(queries, points, 9) if h[0] == "b" or h[1] <= 2]
    assert hits == want


def test_opposite_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [-2.0, 0.0])]
    hits = nearest(frame(spark, rows[:1], "query_id"), frame(spark, rows, "id"), 2).collect()
    assert [(r["id"], r["similarity"]) for r in sorted(hits, key=lambda r: r["rank"])] == [
        ("a", 1.0),
        ("b", -1.0),
    ]


def test_size_checks(spark, points):
    vectors = frame(spark, points, "id")
    queries = frame(spark, points, "query_id")
    for strategy in ("hold_vectors", "hold_queries"):
        with pytest.raises(ValueError, match="broadcast_bytes"):
            nearest(queries, vectors, 3, strategy=strategy, broadcast_bytes=1000)
    hits = nearest(queries, vectors, 3, broadcast_bytes=1000, block_rows=64)
    assert got(hits) == brute(points, points, 3)


def test_no_vectors_or_no_queries(spark, points):
    vectors, queries = frame(spark, points, "id"), frame(spark, points, "query_id")
    assert nearest(queries, vectors.limit(0), 3).count() == 0
    for way in WAYS:
        assert nearest(queries.limit(0), vectors, 3, **way).count() == 0


def test_vectors_of_other_length_are_an_error(spark):
    rows = frame(spark, [("a", [1, 0]), ("b", [1, 0, 0])], "id")
    with pytest.raises(Exception, match="dimensions"):
        nearest(rows.withColumnRenamed("id", "query_id"), rows, 1).collect()


def test_exact_search_skips_cells_of_clustered_data(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 32))
    rows = [(f"v{i:04}", centres[i % 12] + 0.02 * rng.normal(size=32)) for i in range(600)]
    vectors = frame(spark, rows, "id")
    queries = vectors.withColumnRenamed("id", "query_id")
    pivots = blocks.unit_rows(centres)
    index = cells.build_cells(vectors, pivots=pivots)
    facts = cells.cell_facts(index)
    near = queries.withColumn("k", F.lit(5)).withColumn("reach", F.lit(0.01))
    assert cells.visits(index, near, facts, None).count() < 2 * len(rows)
    assert got(nearest_in_cells(index, queries, 5)) == brute(rows, rows, 5)


def test_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(10, 16))
    rows = [(f"v{i:03}", centres[i % 10] + 0.2 * rng.normal(size=16)) for i in range(400)]
    vectors = frame(spark, rows, "id")
    queries = vectors.withColumnRenamed("id", "query_id")
    index = cells.build_cells(vectors, pivots=cells.kmeans_pivots(vectors, 10))
    cells.write_cells(index, str(tmp_path / "index"))
    stored = cells.read_cells(spark, str(tmp_path / "index"))
    hits = nearest_in_cells(stored, queries, 5, probes=2)
    quality = recall(hits, nearest(queries, vectors, 5)).head()
    share = cells.candidate_share(stored, queries, 2, 5).head()
    assert quality["recall"] >= 0.9 and quality["exact_hits"] == 2000
    assert share["candidate_share"] < 0.5


def test_tiles_are_bounded(spark, points):
    """Copies holding a third of all rows, and queries that all visit them, are split."""
    index = cells.build_cells(frame(spark, points, "id"), n_cells=3)
    facts = cells.cell_facts(index)
    assert facts[0].sum() == len(points)
    queries = frame(spark, points, "query_id").withColumn("k", F.lit(3))
    queries = queries.withColumn("reach", F.lit(2.0))
    options = {"exclude_self": False, "block_rows": 30}
    hits = cells._search_tiles(index, queries, facts, None, **options)
    # Each tile gives at most k hits per query, so several tiles give more than k.
    assert hits.groupBy("query_id").count().agg(F.max("count")).head()[0] > 3
    whole = cells._search_tiles(index, queries, facts, None, exclude_self=False, block_rows=10**6)
    assert whole.groupBy("query_id").count().agg(F.max("count")).head()[0] <= 3 * 3


def test_tiles_copy_rows_a_bounded_number_of_times(spark, points, monkeypatch):
    """However small the blocks that are asked for, once copies weigh anything."""
    monkeypatch.setattr(cells, "COPY_BYTES", 0, raising=False)
    copies, search_tiles = [], cells.search_tiles

    def counted(members, asking, plan, kinds, **options):
        copies.append(members.join(plan, "cell").agg(F.sum("guest_cuts")).head()[0])
        copies.append(asking.join(plan, "cell").agg(F.sum("member_cuts")).head()[0])
        return search_tiles(members, asking, plan, kinds, **options)

    monkeypatch.setattr(cells, "search_tiles", counted)
    hits = neighbours_of_all(frame(spark, points, "id"), 5, strategy="cells", block_rows=2, n_cells=9)
    assert got(hits) == brute(points, points, 5, exclude_self=True)
    assert len(copies) == 4 and max(copies) <= 6 * len(points)


def test_tile_cuts_of_large_tables():
    """Tiles grow up to what a task holds, and not beyond."""
    members, guests = np.array([20_000, 80_000]), np.array([3_000_000, 9_000_000])
    by_member, by_guest = cells.tile_cuts(members, guests, 200, (131_072, 200_000), (320, 576))
    assert by_member.max() <= 4 and (-(-members // by_member) <= 131_072).all()
    assert (-(-guests // by_guest) <= 200_000).all()
    moved = (members * by_guest * 320 + guests * by_member * 576).sum()
    assert moved <= 2 * (members * 320 + guests * 576).sum()
    small = cells.tile_cuts(np.array([450]), np.array([900]), 200, (131_072, 200_000), (320, 576))
    assert [cuts.tolist() for cuts in small] == [[3], [5]]


def test_one_pass_queries_answer_more_than_can_be_held(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    for name in ("v7_similar", "v7_similar_refill", "f10_filtered_similar", "v8_browse_similar"):
        want = sorted(map(str, entry.queries()[name](spark, folder).collect()))
        got = entry.queries()[f"{name}_one_pass"](spark, folder, broadcast_bytes=1000)
        assert sorted(map(str, got.collect())) == want


@pytest.mark.parametrize(("n", "k"), [(5, 3), (300, 3), (300, 40)])
def test_nearest_columns(n, k):
    """With exact ties, and with rows that only differ beyond single precision."""
    rng = np.random.default_rng(n + k)
    rows = blocks.unit_rows(rng.normal(size=(n, 6)))
    rows[n // 2] = rows[0]
    rows[1::7] = blocks.unit_rows(rows[2:3] + 1e-9 * rng.normal(size=(len(rows[1::7]), 6)))
    queries = np.concatenate([rows[:3], blocks.unit_rows(rng.normal(size=(4, 6)))])
    single = queries.astype(np.float32), rows.astype(np.float32)
    columns, values = blocks.nearest_columns(queries, rows, *single, k)
    for line, query in enumerate(queries):
        exact = [(round(1 - float(query @ row), 12) + 0.0, i) for i, row in enumerate(rows)]
        want = sorted(exact)[:k]
        assert np.allclose(values[line], [d for d, _ in want], atol=1e-12)
        assert columns[line].tolist() == [i for _, i in want]


def test_surplus_copies_leave_a_block():
    rows = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    ids, kept = blocks.by_id(pa.array(["e", "d", "c", "b", "a"]), rows, 2)
    assert ids.to_pylist() == ["a", "b", "c", "d"]
    assert kept.tolist() == [[0.0, 1.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]


@pytest.mark.parametrize("dim", [3, 64, 150])
def test_centroids(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(f"k{i % 3}", rng.normal(size=dim), int(rng.integers(1, 5))) for i in range(20)]
    data = [(k, [float(x) for x in np.float32(v)], w) for k, v, w in rows]
    df = spark.createDataFrame(data, "key string, vector array<float>, w int").repartition(3)
    means = {r["key"]: r["vector"] for r in weighted_mean(df, "key", dim, F.col("w")).collect()}
    units = {r["key"]: r["vector"] for r in centroids(df, "key", dim).collect()}
    for key in ("k0", "k1", "k2"):
        own = [(np.float32(v).astype(float), w) for k, v, w in rows if k == key]
        want = sum(v * w for v, w in own) / sum(w for _, w in own)
        assert np.allclose(means[key], want)
        plain = np.mean([v for v, _ in own], axis=0)
        assert np.allclose(units[key], plain / np.linalg.norm(plain))


def test_zero_mean_stays_zero(spark):
    rows = [("a", [1.0, 0.0]), ("a", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, vector array<float>")
    assert centroids(df, "key", 2).head()["vector"] == [0.0, 0.0]


def test_mean_rejects_other_lengths(spark):
    df = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "key string, vector array<float>")
    with pytest.raises(Exception, match="does not have 2 dimensions"):
        weighted_mean(df, "key", 2).collect()


def test_columns(spark):
    rows = [([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got_rows = df.select(X.l2_normalize(a), X.cosine_distance(a, b)).collect()
    assert [list(r) for r in got_rows] == [
        [[0.6, 0.8], 1.0],
        [[0.0, 0.0], 1.0],
        [[1.0, 0.0], 0.0],
    ]


def test_seeded_vectors(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "s string")
    rows = [r[0] for r in df.select(X.seeded_vector(F.col("s"), 13)).collect()]
    assert [len(v) for v in rows] == [13] * 3
    assert rows[0] == rows[2] != rows[1]
    assert np.allclose([np.linalg.norm(v) for v in rows], 1)


def clustered(spark, n=4000, groups=60, dim=24):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(groups, dim))
    rows = centres[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dim))
    data = [(i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, "id long, vector array<double>").repartition(4)


def test_recall_on_clustered_rows(spark):
    vectors = clustered(spark)
    queries = vectors.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    index = cells.build_cells(vectors, n_cells=64)
    found = nearest_in_cells(index, queries, 10, probes=6)
    exact = nearest(queries, vectors, 10)
    assert recall(found, exact).head()["recall"] >= 0.9
    assert cells.candidate_share(index, queries, 6, 10).head()["candidate_share"] <= 0.2


def test_rows_are_added_to_an_index(spark, tmp_path):
    vectors = clustered(spark, 600, 10)
    queries = vectors.limit(20).select(F.col("id").alias("query_id"), "vector")
    moved = vectors.filter("id >= 500").unionByName(
        vectors.filter("id < 20").withColumn("vector", F.transform("vector", lambda x: -x))
    )
    index = cells.add_rows(cells.build_cells(vectors.filter("id < 500"), n_cells=7), moved)
    cells.write_cells(index, str(tmp_path / "index"))
    read = cells.read_cells(spark, str(tmp_path / "index"))
    whole = vectors.filter("id BETWEEN 20 AND 499").unionByName(moved)
    want = sorted(map(tuple, nearest(queries, whole, 5).select("query_id", "rank", "id").collect()))
    got = nearest_in_cells(read, queries, 5).select("query_id", "rank", "id")
    assert sorted(map(tuple, got.collect())) == want


def test_too_many_pivots_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(cells, "PIVOT_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer cells"):
        cells.build_cells(clustered(spark, 200, 5), n_cells=50)


def test_calibrated_search_reaches_its_recall_and_says_when_it_cannot(spark):
    from likeness.operators import approximate

    pick = np.random.default_rng(4)
    centres = pick.normal(size=(30, 24))
    near = centres[pick.integers(0, 30, 3000)] + 0.25 * pick.normal(size=(3000, 24))
    grouped = spark.createDataFrame([(i, v) for i, v in enumerate(near.tolist())], "id long, vector array<double>")
    queries = grouped.select(F.col("id").alias("query_id"), "vector")
    exact = nearest(queries, grouped, 8, exclude_self=True)
    for target in (0.7, 0.9, 0.99):
        hits, how = approximate.approximate(queries, grouped, 8, recall=target, exclude_self=True, drawn=100)
        assert not how.exact and how.drawn == 100 and how.share < 0.5
        assert recall(hits, exact).head()["recall"] >= target - 0.02
    even = spark.createDataFrame([(i, v) for i, v in enumerate(pick.normal(size=(600, 64)).tolist())], "id long, vector array<double>")
    hits, how = approximate.approximate(even.withColumnRenamed("id", "query_id"), even, 5)
    assert how.exact and how.share > 0.5
    assert recall(hits, nearest(even.withColumnRenamed("id", "query_id"), even, 5)).head()["recall"] == 1


def test_calibration_of_few_rows(spark):
    from likeness.operators import approximate

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    queries = rows.withColumnRenamed("id", "query_id")
    for some, vectors in ((queries, rows), (queries.limit(0), rows), (queries, rows.limit(1)), (queries, rows.limit(0))):
        hits, how = approximate.approximate(some, vectors, 2, exclude_self=True)
        assert how.recall == 1.0
        want = nearest(some, vectors, 2, exclude_self=True)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, want.collect()))


class Held:
    """What a broadcast looks like to a task."""

    def __init__(self, *value):
        self.value = value


def peak_bytes(work):
    tracemalloc.start()
    try:
        found = work()
        return found, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["<f4", "<f8"])
@pytest.mark.parametrize("k", [3, 300])
def test_held_vectors_are_not_copied_as_a_whole(kind, k):
    """Rows of any length, some of them copies and near copies, in more than one block."""
    rng = np.random.default_rng(21)
    rows = (rng.normal(size=(120_000, 48)) * rng.uniform(0.1, 9, size=(120_000, 1))).astype(kind)
    rows[70_000:70_500], rows[5] = rows[1], 0
    rows[30_000:119_000:997] = rows[2] * (1 + 1e-7 * rng.normal(size=(90, 48)))
    asked = np.concatenate([rows[:3], rng.normal(size=(9, 48)), rows[:1], np.zeros((1, 48))]).astype(float)
    ids = pa.array([f"{i:06}" for i in range(len(rows))])
    queries = [pa.array(range(len(asked))), pa.array(asked.tolist()), pa.array([k] * len(asked), pa.int32())]
    batch = pa.record_batch(queries, names=["query_id", "vector", "k"])
    work = blocks.search_held_vectors(Held(ids, rows), False)
    found, peak = peak_bytes(lambda: list(work([batch])))
    assert peak < 22e6 < rows.nbytes
    unit = blocks.unit_rows(rows.astype(float))
    want = np.round(1 - blocks.unit_rows(asked) @ unit.T, 11) + 0.0
    table = pa.Table.from_batches(found).to_pydict()
    for q in range(len(asked)):
        here = [i for i, x in enumerate(table["query_id"]) if x == q]
        assert [table["rank"][i] for i in here] == list(range(1, k + 1))
        nearest_k = np.lexsort((np.arange(len(rows)), want[q]))[:k]
        assert np.allclose([table["distance"][i] for i in here], want[q][nearest_k], atol=1e-10)
    # Copies and rows as far as all others come by id.
    assert [table["id"][i] for i, x in enumerate(table["query_id"]) if x == 1][:2] == ["000001", "070000"]
    assert [table["id"][i] for i, x in enumerate(table["query_id"]) if x == 13] == ids[:k].to_pylist()


def test_a_tile_holds_its_vectors_as_they_came():
    rng = np.random.default_rng(22)
    rows, asked = rng.normal(size=(100_000, 64)).astype("<f4"), rng.normal(size=(40_000, 64)).astype("<f4")
    asked[8:] = asked[rng.integers(0, 8, len(asked) - 8)]
    values = [pa.chunked_array([pa.array([r.tobytes() for r in some[i : i + 9999]]) for i in range(0, len(some), 9999)]) for some in (asked, rows)]
    left = pa.table({"query_id": pa.array(range(len(asked))), "packed": values[0], "k": pa.array([2] * len(asked), pa.int32()), "reach": pa.array([2.0] * len(asked))})
    right = pa.table({"id": pa.array([f"{i:06}" for i in range(len(rows))]), "packed": values[1]})
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("id", pa.string()), ("distance", pa.float64())])
    found, peak = peak_bytes(lambda: blocks.search_tile("<f4", "<f4", False, schema)(left, right))
    assert peak < 4 * rows.nbytes
    best = (blocks.unit_rows(asked[:8].astype(float)) @ blocks.unit_rows(rows.astype(float)).T).argmax(axis=1)
    table = found.filter(pc.equal(found["rank"], 1)).sort_by("query_id")
    assert table.num_rows == len(asked) and found.num_rows == 2 * len(asked)
    assert table["id"].to_pylist()[:8] == [f"{i:06}" for i in best]


def test_small_vector_tables_are_held_in_their_own_kind(spark, points, monkeypatch):
    held = []
    search = blocks.search_held_vectors
    monkeypatch.setattr(blocks, "search_held_vectors", lambda it, own: held.append(it.value) or search(it, own))
    vectors = frame(spark, points, "id")
    for rows, kind in ((vectors, np.float32), (vectors.withColumn("vector", F.col("vector").cast("array<double>")), np.float64)):
        assert got(neighbours_of_all(rows, 5, strategy="hold_vectors")) == brute(points, points, 5, exclude_self=True)
        assert held.pop()[1].dtype == kind
