"""Whitening against exact covariances from all products."""

import math
from fractions import Fraction

import numpy as np
import pytest

from likeness.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def whole_numbers(vectors):
    return [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]


def exact_covariance(x):
    n, width = len(x), len(x[0])
    z = np.array(x, object) * n - np.array(x, object).sum(axis=0)
    products = z.T.dot(z)
    return np.array([[float(Fraction(products[i, j], n**3)) for j in range(width)] for i in range(width)]), z


def test_every_row_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = whole_numbers(r.embedding for r in rows)
    covariance, z = exact_covariance(x)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = (z.astype(float) / len(x)) @ vectors[:, :8] / np.sqrt(values[:8])
    got = {(r.vec_id, r.component): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == 8 * len(rows)
    signs = [np.sign(want[0, c] * got[rows[0].vec_id, c + 1].whitened) for c in range(8)]
    for at, r in enumerate(rows):
        deviation = int((z[at] ** 2).sum())
        for c in range(8):
            g = got[r.vec_id, c + 1]
            assert (g.n, g.deviation, g.deviation_exact) == (len(x), deviation, str(deviation))
            assert g.whitened == pytest.approx(signs[c] * want[at, c], abs=1e-8)
            assert g.explained == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
            assert 0 <= g.identity_error < 1e-9


def test_covariances_from_variances_are_exact(spark):
    """Also for values whose squares do not fit in a double or a long."""
    pick = np.random.default_rng(3)
    for scale in (1.0, 1e4, 1e12):
        data = (pick.normal(size=(700, 5)) * scale).tolist()
        df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
        fitted = whitening.fit(df.repartition(3))
        covariance, _ = exact_covariance(whole_numbers(data))
        assert (fitted.covariance == covariance).all()
        assert fitted.n == 700 and fitted.sums == np.array(whole_numbers(data), object).sum(axis=0).tolist()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.1], "a"), (1, [0.5, 0.1], "a"), (None, [0.25, -0.5], None), (3, [-0.5, 0.7], "c"),
        (4, None, None), (5, [nan, 1.0], None), (6, [inf, 1.0], None), (7, [None, 1.0], None),
        (8, [], None), (9, [1.0, 2.0, 3.0], None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, Whitened string")
    got = whitening.whitened(df).collect()
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted(
        [(i, c) for i in (1, 1, None, 3) for c in (1, 2)], key=repr
    )
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-9
    for few in (df.limit(0), df.filter("vec_id = 3"), df.filter("vec_id = 1"), df.filter("vec_id = 4")):
        assert whitening.whitened(few).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}
    assert whitening.whitened(line, components=0).collect() == []
