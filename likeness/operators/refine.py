"""Neighbour graph of all rows by refinement: neighbours of neighbours are probably neighbours.

Every row keeps a list of the nearest rows found so far. In each round a row brings together
those on its list and those that have it on theirs; each pair of them that was not brought
together before is compared, and a pair goes on to a list only if it is nearer than the last one
on it. Lists have a bounded length and so has what a row brings together, so the work of a round
grows with the rows and not with their square, and a row that is near to all others is no hot
spot. It ends when few lists change. The first lists come from rows that lie beside each other
when sorted by which side of random hyperplanes they are on.
"""

from __future__ import annotations

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

from likeness.operators import blocks, cells, hashing, neighbours
from likeness.operators.topn import first_per_group
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A list is so many times as long as what is asked; rounds end when this part of all list
# entries is new, or after so many.
LENGTH, STILL, ROUNDS = 2.5, 0.002, 12
# Orders by hyperplanes that the first lists are taken from, and planes of each.
ORDERS, BITS = 4, 16
# What all vectors may weigh to be held by every task.
HELD_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class Graph:
    """``lists`` has (id, other, distance); ``changes`` the part of new entries by round."""

    lists: DataFrame
    changes: tuple[float, ...]


def _pairs_schema(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("id", kind), T.StructField("other", kind), T.StructField("distance", T.DoubleType())]
    )


def beside(batches: Iterator[pa.RecordBatch], kind: str, width: int) -> Iterator[pa.RecordBatch]:
    """Pairs (id, other, distance), both ways, of rows at most ``width`` apart in one order."""
    ids = rows = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = blocks.unit_rows(blocks.unpacked(batch["packed"], kind))
        held = 0 if ids is None else len(ids)
        ids = batch["id"] if ids is None else pa.concat_arrays([ids, batch["id"]])
        rows = fresh if rows is None else np.vstack([rows, fresh])
        for step in range(1, width + 1):
            late = np.arange(max(held, step), len(rows))
            early = late - step
            distance = np.round(1.0 - np.einsum("ij,ij->i", rows[late], rows[early]), blocks.TIE_DECIMALS) + 0.0
            a, b = ids.take(pa.array(late)), ids.take(pa.array(early))
            for one, two in ((a, b), (b, a)):
                yield pa.record_batch([one, two, pa.array(distance)], names=["id", "other", "distance"])
        ids, rows = ids.slice(max(0, len(ids) - width)), rows[-width:]


def first_lists(vectors: DataFrame, length: int, total: int) -> DataFrame:
    """(id, other, distance, fresh): for each row the nearest of those beside it in any order.
    Only the last rows of a task have fewer beside them, so tasks are not too short."""
    dim, kind = neighbours.dimension(vectors) or 1, cells.value_kind(vectors)
    ordered = hashing.coded(vectors, hashing.planes(ORDERS, BITS, dim))
    ordered = ordered.withColumn("place", F.xxhash64("id"))
    width = math.ceil(length / 2 / ORDERS) + 1
    most = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, total // (64 * width)))
    ordered = ordered.repartitionByRange(parts, "cell", "place").sortWithinPartitions("cell", "place")
    schema = _pairs_schema(vectors.schema["id"].dataType)
    near = ordered.select("id", "packed").mapInArrow(lambda b: beside(b, kind, width), schema)
    near = near.filter("id <> other").groupBy("id", "other").agg(F.min("distance").alias("distance"))
    cutoff = first_per_group(near, ["id"], ["distance", "other"], length)
    return cut(cutoff.select("id", "other", "distance", F.lit(True).alias("fresh")))


def met(
    batches: Iterator[pa.RecordBatch], kind: str, length: int | None = None, values=None
) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by ``at``. Of all rows of one ``at``, the pairs of which one is fresh and
    that are near enough for one of their lists, as (id, other, distance); for each row the
    ``length`` nearest of them, if given, and what ties with the last. Vectors are ``packed`` in the rows, or
    ``values`` (a broadcast) by the number ``row``."""

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = table["at"].combine_chunks()
        codes = at.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.diff(codes)) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(codes)]
        if values is None:
            rows = blocks.unit_rows(blocks.unpacked(table["packed"], kind))
        else:
            rows = blocks.unit_rows(values.value[table["row"].to_numpy()].astype(np.float64))
        fresh = table["fresh"].to_numpy(zero_copy_only=False).astype(bool)
        bound = table["bound"].to_numpy(zero_copy_only=False)
        found: list[tuple] = []
        for start, end in zip(starts, ends, strict=True):
            some = rows[start:end]
            far = np.round(1.0 - some @ some.T, blocks.TIE_DECIMALS) + 0.0
            new = fresh[start:end, None] | fresh[None, start:end]
            np.fill_diagonal(new, False)
            far = np.where(new & (far <= bound[start:end, None]), far, np.inf)
            if length is not None and end - start > length:
                last = np.partition(far, length - 1, axis=1)[:, length - 1 : length]
                far = np.where(far <= last, far, np.inf)
            one, two = np.nonzero(np.isfinite(far))
            found.append((one + start, two + start, far[one, two]))
        one, two, far = (np.concatenate(c) for c in zip(*found, strict=True))
        ids = table["id"].combine_chunks()
        columns = [ids.take(pa.array(one)), ids.take(pa.array(two)), pa.array(far)]
        yield from pa.table(columns, names=["id", "other", "distance"]).to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # The last row's group may go on in the next batch.
        at = batch["at"]
        last = at[len(at) - 1]
        codes = at.dictionary_encode()
        open_from = int(np.flatnonzero(np.diff(codes.indices.to_numpy()))[-1]) + 1 if len(codes.dictionary) > 1 else 0
        if open_from or (held and held[-1]["at"][len(held[-1]) - 1] != last):
            if open_from:
                held.append(batch.slice(0, open_from))
            yield from compared(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(open_from))
    if held:
        yield from compared(pa.Table.from_batches(held))


def brought_together(lists: DataFrame, length: int, turn: int) -> DataFrame:
    """(at, id, fresh): for each row the rows on its list, and of those that have it on theirs,
    ``length`` fresh ones and ``length`` others, drawn by a hash that changes with the round."""
    ahead = lists.select(F.col("id").alias("at"), F.col("other").alias("id"), "fresh")
    back = lists.select(F.col("other").alias("at"), "id", "fresh")
    draw = F.xxhash64(F.lit(turn), "at", "id")
    back = first_per_group(back.withColumn("draw", draw), ["at", "fresh"], ["draw", "id"], length)
    both = ahead.unionByName(back.select("at", "id", "fresh"))
    return both.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))


def numbered(packed: DataFrame, kind: str):
    """(held, numbers): the raw values of (id, packed) as a broadcast matrix, and (id, row)."""
    spark, table = packed.sparkSession, packed.toArrow()
    raw = np.frombuffer(b"".join(table["packed"].to_pylist()), kind).reshape(table.num_rows, -1)
    rows = pa.table([table["id"], pa.array(np.arange(table.num_rows, dtype=np.int32))], names=["id", "row"])
    schema = T.StructType([packed.schema["id"], T.StructField("row", T.IntegerType())])
    return spark.sparkContext.broadcast(raw), cut(spark.createDataFrame(rows, schema))


def refined(
    vectors: DataFrame,
    k: int,
    *,
    length: int | None = None,
    still: float = STILL,
    rounds: int = ROUNDS,
    held_bytes: int = HELD_BYTES,
) -> Graph:
    """Lists of ``length`` nearest others of each row of (id, vector), after as many rounds as it
    takes. Ids are unique. Null vectors are an error, as they are in the exact search. Vectors of
    up to ``held_bytes`` are held by all tasks, so that only their numbers are moved in a round."""
    vectors = cut(vectors.select("id", "vector"))
    length = length or max(k, math.ceil(LENGTH * k))
    total, kind = vectors.count(), cells.value_kind(vectors)
    schema = _pairs_schema(vectors.schema["id"].dataType)
    if total < 2:
        return Graph(vectors.sparkSession.createDataFrame([], schema), ())
    one = hashing.planes(1, 1, neighbours.dimension(vectors))
    packed = cut(hashing.coded(vectors, one).select("id", "packed"))
    row_bytes = np.dtype(kind).itemsize * (neighbours.dimension(vectors) or 1) + 64
    held, side = None, "packed"
    if total * row_bytes <= held_bytes:
        held, packed, side = *numbered(packed, kind), "row"
    lists, changes = first_lists(vectors, length, total), []
    for turn in range(rounds):
        full = F.when(F.count("*") >= length, F.max("distance")).otherwise(F.lit(math.inf))
        bounds = lists.groupBy("id").agg(full.alias("bound"))
        known = packed.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
        meeting = brought_together(lists, length, turn).join(known, "id")
        meeting = meeting.repartition("at").sortWithinPartitions("at")
        meeting = meeting.select("at", "id", "fresh", side, "bound")
        pairs = meeting.mapInArrow(lambda batches: met(batches, kind, length, held), schema)
        tried = pairs.withColumn("fresh", F.lit(True)).unionByName(lists.withColumn("fresh", F.lit(False)))
        once = tried.groupBy("id", "other").agg(
            F.min("distance").alias("distance"), F.min("fresh").alias("fresh")
        )
        ranked = first_per_group(once, ["id"], ["distance", "other"], length)
        lists = cut(ranked.select("id", "other", "distance", "fresh"))
        changes.append(lists.filter("fresh").count() / (total * min(length, total - 1)))
        if changes[-1] <= still:
            break
    return Graph(lists.select("id", "other", "distance"), tuple(changes))


def neighbour_graph(vectors: DataFrame, k: int, **how) -> DataFrame:
    """Each vector's k nearest others, as far as refinement finds them: (query_id, rank, id,
    distance, similarity), as ``neighbours.neighbours_of_all`` gives them exactly."""
    lists = refined(vectors, k, **how).lists
    hits = first_per_group(lists, ["id"], ["distance", "other"], k)
    hits = hits.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("id"), "distance")
    return neighbours.with_similarity(hits)
