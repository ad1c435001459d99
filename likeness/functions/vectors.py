"""Column builders over ``array<float|double>``: exact, for vectors held in a row.

Searches over many vectors use the NumPy blocks in ``likeness.operators`` instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUES_PER_HASH = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is evaluated again for each element, which would
    make a norm inside a transform quadratic; binding it as an element avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    squares = F.aggregate(doubles(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""

    def scaled(v: Column) -> Column:
        return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return let(doubles(vector), scaled)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a zero vector, as it has no direction."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths).otherwise(F.lit(1.0))


def similarity(distance: Column) -> Column:
    return 1 - distance


def seeded_vector(seed: Column, dim: int = 768) -> Column:
    """A unit vector that depends on ``seed`` alone, for tests without a model.

    Each hash of the seed and a counter gives eight values, uniform on [-1, 1).
    """

    def values(counter: Column) -> Column:
        digest = F.sha2(F.concat(seed, F.lit(":"), counter.cast("string")), 256)
        return let(
            digest,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(_VALUES_PER_HASH - 1)),
                lambda i: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("double")
                / float(2**31)
                - 1,
            ),
        )

    hashes = -(-dim // _VALUES_PER_HASH)
    drawn = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), values))
    return l2_normalize(F.slice(drawn, 1, dim))
