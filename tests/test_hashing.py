"""Search by hyperplanes: codes, probes, cut buckets and measured recall."""

import itertools

import numpy as np
import pytest
from likeness.operators import hashing
from likeness.operators.neighbours import nearest, recall
from pyspark.sql import functions as F


def frame(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id long, vector array<double>")
    return df.repartition(4), df.withColumnRenamed("id", "query_id")


def test_probes_come_by_rising_distance():
    pick = np.random.default_rng(1)
    normals = hashing.planes(3, 5, 8)
    assert set(np.unique(normals)) == {-1.0, 1.0}
    side = hashing.sides(pick.normal(size=(20, 8)), normals)
    found = hashing.probed(side, 7)
    for row, t in itertools.product(range(20), range(3)):
        own = int(hashing.codes(side)[row, t])
        near = np.argsort(np.abs(side[row, t]), kind="stable")[: hashing.NEAR_PLANES]
        ways = []
        for n in range(1 << hashing.NEAR_PLANES):
            some = [b for r, b in enumerate(near) if n >> r & 1]
            ways.append((sum(side[row, t, b] ** 2 for b in some), n, own ^ sum(1 << int(b) for b in some)))
        assert found[row, t].tolist() == [code for _, _, code in sorted(ways)[:7]]
        assert own >> 5 == t


def test_recall_is_what_was_measured(spark):
    pick = np.random.default_rng(2)
    centres = pick.normal(size=(40, 16))
    vectors, queries = frame(spark, centres[pick.integers(0, 40, 3000)] + 0.3 * pick.normal(size=(3000, 16)))
    index = hashing.build_hashed(vectors, queries, 5, bucket_rows=64, exclude_self=True)
    assert 1 <= len(index.normals) < hashing.TABLES and index.recall >= 0.9 and index.drawn == hashing.DRAWN
    exact = nearest(queries, vectors, 5, exclude_self=True)
    found = hashing.search_hashed(index, queries, 5, exclude_self=True).cache()
    assert recall(found, exact).head()["recall"] >= 0.88
    assert found.filter("query_id = id").count() == 0
    assert found.groupBy("query_id", "id").count().filter("count > 1").count() == 0
    assert hashing.pair_share(index, queries).head()["pair_share"] < 0.5
    # Cut into tiles of a few rows the result is the same.
    cut = hashing.search_hashed(index, queries, 5, exclude_self=True, block_rows=40)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, found.collect()))


def test_copies_of_one_row_are_cut_into_parts(spark):
    rows = np.vstack([np.tile([1.0, 2.0, 3.0], (900, 1)), np.random.default_rng(3).normal(size=(100, 3))])
    vectors, queries = frame(spark, rows)
    some = queries.filter("query_id % 100 = 0")
    index = hashing.build_hashed(vectors, some, 3, bits=4, tables=4)
    found = hashing.search_hashed(index, some, 3, block_rows=50)
    exact = nearest(some, vectors, 3)
    copies = F.col("query_id") < 900
    assert sorted(map(tuple, found.filter(copies).collect())) == sorted(map(tuple, exact.filter(copies).collect()))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    vectors, queries = frame(spark, np.eye(3)[:n])
    index = hashing.build_hashed(vectors, queries, 2)
    found = hashing.search_hashed(index, queries, 2).collect()
    assert {(r.query_id, r.id) for r in found if r.rank == 1} == {(i, i) for i in range(n)}
    none = hashing.search_hashed(index, queries.limit(0), 2)
    assert none.collect() == [] and hashing.pair_share(index, queries.limit(0)).head()["pairs"] == 0


def test_slices_of_a_batch_are_coded_a_few_rows_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(hashing, "BATCH_CELLS", 4000)
    normals = hashing.planes(10, 4, 8)
    batch = pa.record_batch([pa.array(range(1000))], names=["id"])
    slices = list(hashing.few_at_a_time(iter([batch, batch.slice(0, 0)]), normals, 5))
    assert max(len(s) for s in slices) <= 10 and sum(len(s) for s in slices) == 1000
    assert pa.Table.from_batches(slices)["id"].to_pylist() == list(range(1000))
