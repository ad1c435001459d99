import pytest
from likeness.operators.topn import first_per_group
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [5, 1200])
def test_first_per_group(spark, n):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("g"), "id"
    )
    kept = first_per_group(rows, ["g"], ["id"], n).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        want.setdefault(r["g"], []).append(r["id"])
    expected = {(g, v, i + 1) for g, values in want.items() for i, v in enumerate(values[:n])}
    assert {(r["g"], r["id"], r["rank"]) for r in kept} == expected


def test_groups_are_cut_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    plan = first_per_group(rows, ["g"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 5, Partial" in plan
