"""Exact top-k and mixing against brute force, with edge cases."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.llm import mixing, queries, topk

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, score string"


def test_topk_is_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op10_exact_topk(spark, SF).collect()))
    assert got == brute.top(rows, lambda q: q % 20 == 0, 20)


def test_topk_edges(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    pick = random.Random(1)
    rows = [(i, [round(pick.gauss(0, 0.3), 2) for _ in range(5)], "x") for i in range(60)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5], None) for i in range(100, 160)]  # ties, a hot vector
    rows += [(200, None, "x"), (201, [1.0, None], "x"), (202, [float("nan")], "x"), (203, [float("-inf")], "x")]
    rows += [(204, [], "x"), (205, [0.0], "x"), (206, [3.0, -2.0], "x"), (None, [1.0], "x")]
    df = spark.createDataFrame(rows + rows[:3], VECTORS)
    got = sorted(map(tuple, topk.top_k(df, F.lit(True), 4).collect()))
    plain = [(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v, _ in rows if i is not None]
    assert got == brute.top(plain, lambda q: True, 4)
    few = topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 1, 20).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(1, 1), (1, 2)]
    assert topk.top_k(df.limit(0), F.lit(True), 3).count() == 0
    assert topk.top_k(df, F.lit(False), 3).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_the_index_stops_only_on_proof(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, 32))
    items = np.floor(64 * (centres[rng.integers(0, 10, 3000)] + 0.1 * rng.normal(size=(3000, 32))))
    items = items.astype(np.int64)
    stopped = []
    real = topk.Index.possible
    monkeypatch.setattr(topk.Index, "possible", staticmethod(lambda s, rest, n, k: stopped.append(bool(rest.any())) or real(s, rest, n, k)))
    queries_ = items[:64]
    query, item, score = topk.Index(items).best(queries_, 10)
    assert any(stopped)
    true = queries_ @ items.T
    for q in range(64):
        mine = sorted((-s, i) for s, i in zip(score[query == q].tolist(), item[query == q].tolist()))
        assert mine[:10] == sorted((-s, i) for i, s in enumerate(true[q].tolist()))[:10]


def test_large_components(spark):
    rows = [(i, [float(10**7 + i), -float(10**6 * i)], "x") for i in range(40)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string"), F.lit(True), 3).collect()))
    assert got == brute.top([(i, v) for i, v, _ in rows], lambda q: True, 3)


def test_mixing_sql(spark):
    from compare import compare, oracle

    name = "op1_mix_sources"
    assert compare(spark, oracle(SF), SF, name, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_expected_tokens_keep_the_targets(spark):
    rows = queries.op1_mix_sources(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    cells = {}
    for r in rows:
        cell = (r.source, r.lang, r.topic)
        cells[cell] = cells.get(cell, 0) + r.tokens
    targets = []
    for m, power in enumerate(mixing.TEMPERS.values()):
        held = {}
        for c, n in cells.items():
            held[c[m]] = held.get(c[m], 0) + n
        whole = sum(n**power for n in held.values())
        targets.append({v: n**power / whole for v, n in held.items()})
    want = brute.raked(cells, targets, mixing.SWEEPS)
    chance = brute.clipped(cells, want, mixing.KEEP)
    for r in rows:
        assert r.probability == pytest.approx(chance[r.source, r.lang, r.topic], abs=2e-9)
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(mixing.KEEP * sum(cells.values()), rel=1e-6)
    expected, whole = {}, 0
    for r in rows:
        expected[r.lang] = expected.get(r.lang, 0) + r.tokens * r.probability
        whole += r.tokens * r.probability
    for lang, tokens in expected.items():
        assert tokens / whole == pytest.approx(targets[1][lang], abs=0.02)


def test_one_odd_document_does_not_change_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**9, "some words", "xx", "odd", 10)], docs.schema)
    plain = mixing.sample(docs).agg(F.sum(F.length("text"))).first()[0]
    with_odd = mixing.sample(docs.union(odd))
    assert with_odd.filter("doc_id = 1000000000").count() == 1  # taken whole
    assert with_odd.agg(F.sum(F.length("text"))).first()[0] == pytest.approx(plain, rel=0.01)


def test_targets_that_contradict_each_other_are_told(spark):
    rows = [(i, "a" if i % 2 else "b", "en" if i % 2 else "de", 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long")
    given = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    with pytest.warns(UserWarning, match="off its target"):
        assert mixing.with_mixture(docs, given, "tokens", keep=0.5).count() == 100
    with pytest.raises(ValueError, match="off its target"):
        mixing.with_mixture(docs, given, "tokens", strict=True)
    fine = mixing.with_mixture(docs, {"source": {"a": 0.9, "b": 0.1}}, "tokens", keep=0.5, strict=True)
    assert {(r.source, r.probability) for r in fine.collect()} == {("a", 0.9), ("b", 0.1)}
    all_of_it = mixing.with_mixture(docs, {"source": 1.0}, "tokens", keep=1.0)
    assert {r.probability for r in all_of_it.collect()} == {1.0}


def test_mixing_edges(spark):
    rows = [(i, "a" if i % 3 else None, "en", 10, "x") for i in range(600)]
    rows += [(None, "b", None, None, "x"), (7000, "b", "en", -5, None), (7001, "c", "de", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, tokens long, margin0 string")
    given = {"source": {"a": 1.0, mixing.NO_VALUE: 3.0, "absent": 5.0}, "lang": 0.5}
    got = mixing.with_mixture(docs, given, "tokens")
    assert got.columns == [*docs.columns, "probability", "sampled"] and got.count() == 603
    found = {(r.source, r.probability) for r in got.collect()}
    # A third of the tokens is to have three quarters: a sixth of the rate for the rest.
    assert found == {("a", 0.166666667), (None, 1.0), ("b", 0.0), ("c", 0.0)}
    assert got.filter("source IS NULL AND NOT sampled").count() == 0
    kept = got.filter("source = 'a' AND sampled").count()
    assert 30 < kept < 110
    assert mixing.with_mixture(docs.limit(0), given, "tokens").count() == 0
    text = docs.withColumn("text", F.lit("words")).withColumn("Topic", F.lit(1))
    kept = mixing.sample(text, {"source": 1.0, "topic": 1.0}, keep=None)
    assert kept.columns == text.columns and kept.count() == 603
    assert mixing.sample(text.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.with_mixture(got, given, "tokens")
