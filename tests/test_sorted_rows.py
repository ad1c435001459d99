"""Pages of stored sorted runs against the whole sorted list."""

import random
import re

import pytest
from likeness.operators import ordering
from likeness.session import fresh_dir
from likeness.sources.sorted_rows import SortedRows


@pytest.fixture(scope="module")
def stored(spark):
    pick = random.Random(5)
    rows = [(i, pick.choice(["a", "b", "hot", "hot", "é"]) if i % 3 else "hot", i * 2) for i in range(1200)]
    rows += [(5000, None, 1)]
    cards = spark.createDataFrame(rows, "id long, name string, x long")
    kept = SortedRows(spark, fresh_dir(spark, "sorted"))
    kept.write(cards.repartition(4), run_rows=100)
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0]))
    return cards, kept, order


@pytest.mark.parametrize("offset,limit", [(0, 20), (12, 7), (595, 40), (1180, 30), (1201, 5), (5000, 5), (300, 400)])
def test_any_page_is_read_from_its_runs(stored, offset, limit):
    cards, kept, order = stored
    got = kept.page(offset, limit)
    want = ordering.page(cards, offset, limit)
    assert [(r["id"], r["name"], r["x"]) for r in got.orderBy("name", "id").collect()] == order[offset : offset + limit]
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_page_opens_few_files_however_deep(spark, stored):
    _, kept, order = stored
    runs = kept.fences().count()
    assert 8 <= runs <= 13  # a name that most rows have is cut by the id
    for share in (0.01, 0.5, 0.99):
        plan = kept.page(int(len(order) * share), 10)._jdf.queryExecution().executedPlan().toString()
        (asked,) = set(re.findall(r"PartitionFilters: \[([^\]]*)\]", plan))
        asked = re.sub(r"#\d+", "", asked)
        assert "run" in asked and len(re.findall(r"\d+", asked)) <= 2


def test_pages_from_a_key(stored):
    _, kept, order = stored
    named = [r for r in order if r[1] is not None]
    for name, last, limit in (("b", None, 9), ("hot", 601, 150), ("hot", None, 700), ("a", 10**6, 3), ("zz", None, 3), ("é", None, 500)):
        want = [r for r in named if (r[1].encode(), r[0]) > (name.encode(), -1 if last is None else last)][:limit]
        assert [tuple(r) for r in kept.page_from(name, limit, last).select("id", "name", "x").collect()] == want


def test_no_rows(spark, stored):
    cards, _, _ = stored
    none = SortedRows(spark, fresh_dir(spark, "sorted"))
    none.write(cards.limit(0))
    assert none.page(0, 5).collect() == [] and none.page_from("a", 5).collect() == []
