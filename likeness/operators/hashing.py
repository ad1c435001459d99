"""Approximate search by random hyperplanes.

A vector's code in one table says on which side of some hyperplanes it lies; near vectors often
have the same code, in one of several tables at least. A query also looks under the codes that
it would have if it lay on the other side of those planes it is nearest to. Rows of one code
are never paired with each other in one task beyond a bounded size: both sides of a code are
cut into parts, and each pair of parts is a tile, as in ``cells``.

How many tables are needed is measured on drawn queries, whose true neighbours are known.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.operators import blocks, cells, neighbours
from likeness.operators.approximate import DRAWN, ERRORS, draw
from likeness.operators.topn import first_per_group
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tables at most, rows that a code should have, and codes a query looks under in each table.
TABLES, BUCKET_ROWS, PROBES = 16, 1024, 5
# Codes are made of so many bits at most; other sides are tried of so many planes.
MOST_BITS, NEAR_PLANES = 24, 4
# Values that the vectors of one slice of a batch have under all their codes.
BATCH_CELLS = 2_000_000


def planes(tables: int, bits: int, dim: int) -> np.ndarray:
    """Normals of the hyperplanes, tables x bits x dim, with entries 1 and -1: a sign is the
    first bit of MD5 over ``table:bit:dimension``."""
    names = (f"{t}:{b}:{d}" for t in range(tables) for b in range(bits) for d in range(dim))
    signs = [1.0 if hashlib.md5(n.encode()).digest()[0] < 128 else -1.0 for n in names]
    return np.array(signs).reshape(tables, bits, dim)


def sides(rows: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Rows x tables x bits: how far on which side of each plane the rows lie."""
    tables, bits, dim = normals.shape
    return (rows @ normals.reshape(-1, dim).T).reshape(len(rows), tables, bits)


def codes(side: np.ndarray) -> np.ndarray:
    """Rows x tables: table and code in one number."""
    bits = side.shape[2]
    own = (side > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return own + (np.arange(side.shape[1], dtype=np.int64) << bits)


def probed(side: np.ndarray, probes: int) -> np.ndarray:
    """Rows x tables x probes: the own code and then those across the nearest planes, by rising
    sum of squared distances; -1 where there are no more."""
    bits = side.shape[2]
    near = min(bits, NEAR_PLANES)
    distance = np.abs(side)
    order = np.argsort(distance, axis=2, kind="stable")[..., :near]
    squares = np.take_along_axis(distance, order, axis=2) ** 2
    choices = np.array(list(itertools.product((0, 1), repeat=near)))[:, ::-1]  # by their number
    score = squares @ choices.T.astype(float)
    best = np.argsort(score, axis=2, kind="stable")[..., :probes]
    flips = (np.int64(1) << order.astype(np.int64)) @ choices.T.astype(np.int64)
    return codes(side)[..., None] ^ np.take_along_axis(flips, best, axis=2)


@dataclass(frozen=True)
class Hashed:
    """``members`` has (id, packed, cell) once for each table; ``tables`` as many as were found
    to be needed, with the measured ``recall`` of the drawn queries and its standard ``error``."""

    normals: np.ndarray
    members: DataFrame
    kind: str
    recall: float
    error: float
    drawn: int


def few_at_a_time(batches: Iterator[pa.RecordBatch], normals: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches, none empty, so that what a worker holds does not grow with a batch: the
    copies of a slice's vectors under all codes, and the sides it tries, are BATCH_CELLS at most."""
    tables, _, dim = normals.shape
    step = max(1, BATCH_CELLS // (tables * max(probes * dim, 2**NEAR_PLANES)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def coded(vectors: DataFrame, normals: np.ndarray) -> DataFrame:
    """(id, packed, cell): each row once for each table."""
    held, kind = vectors.sparkSession.sparkContext.broadcast(normals), cells.value_kind(vectors)
    schema = T.StructType(
        [vectors.schema["id"], T.StructField("packed", T.BinaryType()), T.StructField("cell", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, held.value, 1):
            rows = blocks.matrix(batch["vector"], held.value.shape[2])
            cell = codes(sides(rows, held.value))
            each = pa.array(np.repeat(np.arange(len(rows)), cell.shape[1]))
            raw = blocks.packed(batch["vector"], kind)
            columns = [batch["id"].take(each), raw.take(each), pa.array(cell.ravel())]
            yield pa.record_batch(columns, names=["id", "packed", "cell"])

    return vectors.select("id", "vector").mapInArrow(run, schema)


def looked_up(queries: DataFrame, normals: np.ndarray, probes: int) -> DataFrame:
    """(query_id, k, reach, packed, cell): each query under each code it looks at."""
    held, kind = queries.sparkSession.sparkContext.broadcast(normals), cells.value_kind(queries)
    schema = T.StructType(
        [
            queries.schema["query_id"],
            T.StructField("k", T.IntegerType()),
            T.StructField("reach", T.DoubleType()),
            T.StructField("packed", T.BinaryType()),
            T.StructField("cell", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches, held.value, probes):
            rows = blocks.matrix(batch["vector"], held.value.shape[2])
            cell = probed(sides(rows, held.value), probes).reshape(len(rows), -1)
            each = pa.array(np.repeat(np.arange(len(rows)), cell.shape[1]))
            yield pa.record_batch(
                [
                    batch["query_id"].take(each),
                    batch["k"].take(each),
                    pa.array(np.full(len(each), np.inf)),
                    blocks.packed(batch["vector"], kind).take(each),
                    pa.array(cell.ravel()),
                ],
                names=schema.fieldNames(),
            )

    return queries.select("query_id", "k", "vector").mapInArrow(run, schema)


def measured(some: DataFrame, vectors: DataFrame, k: int, normals: np.ndarray, probes: int, exclude_self: bool):
    """(mean, error, n): for each number of tables, the part of the drawn queries' true
    neighbours that lie under a code they look at. Queries and neighbours come to the driver."""
    table = some.orderBy("query_id").toArrow()
    truth = neighbours.nearest(some, vectors, k, exclude_self=exclude_self).select("query_id", "id")
    found = vectors.join(F.broadcast(truth), "id").select("query_id", "vector").toArrow()
    if not found.num_rows:
        return None
    at = {q: i for i, q in enumerate(table["query_id"].to_pylist())}
    asked = np.array([at[q] for q in found["query_id"].to_pylist()])
    looked = probed(sides(blocks.matrix(table["vector"]), normals), probes)
    lies = codes(sides(blocks.matrix(found["vector"]), normals))
    met = np.logical_or.accumulate((looked[asked] == lies[..., None]).any(axis=2), axis=1)
    hits = np.zeros((table.num_rows, len(normals)))
    np.add.at(hits, asked, met)
    wanted = np.bincount(asked, minlength=table.num_rows)
    part = hits[wanted > 0] / wanted[wanted > 0, None]
    return part.mean(axis=0), part.std(axis=0) / math.sqrt(len(part)), len(part)


def build_hashed(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    recall: float = 0.9,
    tables: int = TABLES,
    bits: int | None = None,
    probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS,
    drawn: int = DRAWN,
    exclude_self: bool = False,
) -> Hashed:
    """Tables until the drawn ``queries`` find the asked part of their true neighbours, less
    ERRORS standard errors; all ``tables`` if they do not, with what they found. Bits by the
    number of rows, unless given. The rows are stored with their codes."""
    vectors = vectors.select("id", "vector")
    total, dim = vectors.count(), neighbours.dimension(vectors) or 1
    bits = bits or min(MOST_BITS, max(2, round(math.log2(max(1, total) / bucket_rows))))
    normals = planes(tables, bits, dim)
    some = cut(draw(queries.select("query_id", "vector"), drawn))
    seen = measured(some, vectors, k, normals, probes, exclude_self) if total else None
    if seen is None:
        mean, error, n, use = [1.0] * tables, [0.0] * tables, 0, 1
    else:
        mean, error, n = seen
        enough = mean - ERRORS * error >= recall
        use = int(np.argmax(enough)) + 1 if enough.any() else tables
    normals = normals[:use]
    members = cut(coded(vectors, normals))
    return Hashed(normals, members, cells.value_kind(vectors), float(mean[use - 1]), float(error[use - 1]), n)


def search_hashed(
    index: Hashed,
    queries: DataFrame,
    k: int,
    *,
    probes: int = PROBES,
    exclude_self: bool = False,
    block_rows: int = 16_384,
) -> DataFrame:
    """Hits (query_id, rank, id, distance, similarity) of (query_id, vector). Rows met under
    several codes count once."""
    asked = queries.select("query_id", F.lit(k).cast("int").alias("k"), "vector")
    asking = cut(looked_up(asked, index.normals, probes))
    plan = cut(_sizes(index, asking).select(
        "cell",
        F.ceil(F.col("members") / block_rows).cast("int").alias("member_cuts"),
        F.ceil(F.col("guests") / block_rows).cast("int").alias("guest_cuts"),
    ))
    kinds = cells.value_kind(queries), index.kind
    found = cells.search_tiles(index.members, asking, plan, kinds, exclude_self=exclude_self)
    once = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return neighbours.with_similarity(first_per_group(once, ["query_id"], ["distance", "id"], k))


def _sizes(index: Hashed, asking: DataFrame) -> DataFrame:
    """(cell, members, guests) of the codes that have both."""
    members = index.members.groupBy("cell").agg(F.count("*").alias("members"))
    guests = asking.groupBy("cell").agg(F.count("*").alias("guests"))
    return members.join(guests, "cell")


def pair_share(index: Hashed, queries: DataFrame, probes: int = PROBES) -> DataFrame:
    """One row: the pairs that a search compares, a pair met under several codes each time, all
    pairs, and the share."""
    asked = queries.select("query_id", F.lit(1).cast("int").alias("k"), "vector")
    sizes = _sizes(index, looked_up(asked, index.normals, probes))
    all_pairs = index.members.count() // max(1, len(index.normals)) * queries.count()
    pairs = F.coalesce(F.sum(F.col("members") * F.col("guests")), F.lit(0)).alias("pairs")
    return sizes.agg(pairs, F.lit(all_pairs).cast("long").alias("all_pairs")).withColumn(
        "pair_share", F.try_divide("pairs", "all_pairs")
    )
