"""Whitening by principal components, with covariances recovered from variances alone.

``Cov(a, b) = (Var(a + b) - Var(a) - Var(b)) / 2``, so only sums of squares are gathered: of
every dimension, and of the sum of every two. Values are whole numbers, centred on the whole
part of their mean before they are squared; the fraction of the mean is put right exactly, in
whole numbers too. Tasks send one number for each dimension and pair, which Spark adds up, so
what reaches the driver depends on the dimensions and not on the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.llm.common import key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Whole values are held between these, so that differences of two fit in 63 bits.
BOUND = float(1 << 61)
# Rows that are squared at once; a block of them stays in a core's cache.
BLOCK = 512
# Sums travel as limbs of so many bits, the last one with the sign, and are added as longs.
LIMB = 40
LIMBS = 4


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, start, values): the rows whose vector has entries that are all there and
    finite, where each one's entries start, and all entries, as doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(values)  # a null entry is not a number here
    before = np.concatenate([[0], np.cumsum(bad)])
    size = np.diff(offsets)
    there = np.asarray(vectors.is_valid()) & (size > 0) & (before[offsets[1:]] == before[offsets[:-1]])
    rows = np.flatnonzero(there)
    return rows, offsets[rows], values


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows with a whole vector of that width, and its values as whole numbers."""
    rows, start, values = whole(vectors)
    size = np.diff(vectors.offsets.to_numpy().astype(np.int64))[rows]
    rows, start = rows[size == width], start[size == width]
    entries = values[start[:, None] + np.arange(width)[None, :]]
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(SCALE * entries), -BOUND, BOUND)
    return rows, scaled.astype(np.int64) + SHIFT


def limbs(value: int) -> list[int]:
    """``value`` cut into LIMBS numbers that can be added each on its own."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def joined(parts) -> int:
    return sum(int(part) << (LIMB * at) for at, part in enumerate(parts))


def squares(block: np.ndarray) -> list[int]:
    """Exact sums of squares of the columns of ``block`` and then of the sums of columns i and
    j, for i below j in that order."""
    most = 2 * int(np.abs(block).max(initial=0))
    bound = most * most * max(1, len(block))
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    wide = np.ascontiguousarray(block.T.astype(kind))

    def summed(a):
        return (a * a).sum(axis=1) if kind is object else np.einsum("ij,ij->i", a, a)

    found = [summed(wide)]
    found += [summed(wide[i + 1 :] + wide[i]) for i in range(len(wide) - 1)]
    return [int(v) for part in found for v in part]


def per_task(rows: DataFrame, vector: str, schema: str, gathered) -> DataFrame:
    """One small table for each task: ``gathered`` takes the task's vectors, batch by batch."""
    spark_schema = T._parse_datatype_string(schema)
    names = spark_schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        columns = list(zip(*gathered(b.column(0) for b in batches), strict=False)) or [()] * len(names)
        target = to_arrow_schema(spark_schema)
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return rows.select(key(vector)).mapInArrow(run, schema)


def added(tables: DataFrame, *keys: str) -> dict[tuple, int]:
    """Sums of limbs by ``keys``, as whole numbers."""
    sums = [F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]
    found = tables.groupBy(*keys).agg(*sums).collect()
    return {tuple(r[k] for k in keys): joined(r[f"l{i}"] for i in range(LIMBS)) for r in found}


LIMB_COLUMNS = ", ".join(f"l{i} long" for i in range(LIMBS))


@dataclass(frozen=True)
class Fit:
    """Of ``n`` rows: their exact sums, the exact squares of ``n * x - sum``, summed, for each
    dimension and pair, and components that whiten, one a column."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    whiten: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)


def counted(rows: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """(width, n, sums) of the commonest width; of equally common ones, of the greatest."""

    def gathered(columns):
        held: dict[int, list[int]] = {}
        for column in columns:
            at, _, _ = whole(column)
            sizes = np.diff(column.offsets.to_numpy().astype(np.int64))[at]
            for width in np.unique(sizes).tolist():
                _, x = integers(column, width)
                mine = held.setdefault(width, [0] * (width + 1))
                mine[0] += len(x)
                low = x & ((1 << 31) - 1)  # the halves of many values can be added as longs
                high = x >> 31
                for i, (a, b) in enumerate(zip(low.sum(0).tolist(), high.sum(0).tolist(), strict=True)):
                    mine[i + 1] += a + (b << 31)
        for width, mine in held.items():
            for slot, value in enumerate(mine):
                yield width, slot, *limbs(value)

    schema = f"width int, slot int, {LIMB_COLUMNS}"
    found = added(per_task(rows, vector, schema, gathered), "width", "slot")
    if not found:
        return 0, 0, []
    _, width = max((n, width) for (width, slot), n in found.items() if slot == 0)
    return width, found[width, 0], [found[width, i + 1] for i in range(width)]


def squared(rows: DataFrame, vector: str, n: int, sums: list[int]) -> dict[int, int]:
    """The exact sum of squares of ``x - sum // n`` for every dimension and every pair's sum."""
    centre, width = np.array([s // n for s in sums], np.int64), len(sums)

    def gathered(columns):
        total = [0] * (width * (width + 1) // 2)
        for column in columns:
            _, x = integers(column, width)
            for at in range(0, len(x), BLOCK):
                total = [a + b for a, b in zip(total, squares(x[at : at + BLOCK] - centre), strict=True)]
        for slot, value in enumerate(total):
            yield slot, *limbs(value)

    tables = per_task(rows, vector, f"slot int, {LIMB_COLUMNS}", gathered)
    return {slot: value for (slot,), value in added(tables, "slot").items()}


def assembled(n: int, sums: list[int], found: dict[int, int]) -> np.ndarray:
    """The covariance, each entry rounded once: variances of pairs less those of their parts."""
    width, rest = len(sums), [s % n for s in sums]
    # sum (n x - S)^2 = n^2 sum (x - m)^2 - n r^2, for S = n m + r.
    own = [n * n * found[i] - n * rest[i] ** 2 for i in range(width)]
    covariance, slot = np.empty((width, width)), width
    for i in range(width):
        covariance[i, i] = own[i] / n**3
        for j in range(i + 1, width):
            both = n * n * found[slot] - n * (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (both - own[i] - own[j]) / (2 * n**3)
            slot += 1
    return covariance


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The components of all whole vectors; None where there is none."""
    width, n, sums = counted(rows, vector)
    if not n:
        return None
    covariance = assembled(n, sums, squared(rows, vector, n, sums))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Directions in which the rows do not differ cannot be brought to variance one.
    least = values[0] * width * np.finfo(float).eps
    use = min(components, int((values > max(least, 0.0)).sum()))
    vectors = vectors[:, :use]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(use)] < 0, -1.0, 1.0)
    return Fit(n, sums, covariance, values[:use], vectors / np.sqrt(values[:use]))


def projected(x: np.ndarray, fitted: Fit) -> np.ndarray:
    n = fitted.n
    y = (x - np.array([s // n for s in fitted.sums], np.int64)).astype(float)
    return (y - np.array([s % n / n for s in fitted.sums])) @ fitted.whiten


def deviations(x: np.ndarray, fitted: Fit) -> list[int]:
    """Of each row, the exact sum of ``(n * x - sum) ** 2`` over the dimensions."""
    n = fitted.n
    y = x - np.array([s // n for s in fitted.sums], np.int64)
    rest = np.array([s % n for s in fitted.sums], np.int64)
    most = n * (int(np.abs(y).max(initial=0)) + 1)
    kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
    z = y.astype(kind) * n - rest.astype(kind)
    return [int(v) for v in (z * z).sum(axis=1)]


def identity_error(rows: DataFrame, vector: str, fitted: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    width, use = len(fitted.sums), fitted.whiten.shape[1]

    def gathered(columns):
        total = np.zeros((use + 1, use))
        for column in columns:
            w = projected(integers(column, width)[1], fitted)
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        for i, row in enumerate(total.tolist()):
            for j, value in enumerate(row):
                yield i, j, value

    tables = per_task(rows, vector, "i int, j int, value double", gathered)
    total = np.zeros((use + 1, use))
    for r in tables.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        total[r.i, r.j] = r.value
    mean = total[0] / fitted.n
    return float(np.abs(total[1:] / fitted.n - np.outer(mean, mean) - np.eye(use)).max(initial=0.0))


def whitened(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for every row whose
    vector is whole and each component, numbered from 1 by falling variance.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so are
    those of another width than the commonest. Entries beyond 2^61 / 1024 count as that.
    Rows with a null id and repeated rows count and are returned like any other. Components
    without variance are left out, so rows that are all equal, one row alone, and an empty
    table give no rows. ``deviation`` is a whole number as text, of any size. Other columns are
    left out.
    """
    spark, kept = rows.sparkSession, rows.select(key(id), key(vector))
    kind = rows.schema[id].dataType
    schema = T.StructType(
        [
            T.StructField(id, kind),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.StringType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    fitted = fit(kept, vector, components)
    if fitted is None or not fitted.whiten.shape[1]:
        return spark.createDataFrame([], schema)
    error = identity_error(kept, vector, fitted)
    width, use = len(fitted.sums), fitted.whiten.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), width)
            each = np.repeat(np.arange(len(at)), use)
            told = pa.array([str(v) for v in deviations(x, fitted)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, use + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), fitted.n, np.int64)),
                    told.take(pa.array(each)),
                    pa.array(projected(x, fitted).reshape(-1)),
                    pa.array(np.tile(fitted.explained, len(at))),
                    pa.array(np.full(len(each), error)),
                ],
                names=schema.fieldNames(),
            )

    return kept.mapInArrow(run, schema)
