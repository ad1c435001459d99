"""Exact nearest neighbours by cosine distance, for whole tables of queries.

Three ways with the same result; which one runs depends on checked sizes:

* the vectors fit the broadcast bound: every query is answered where it lies, nothing
  is shuffled;
* the queries fit it: one pass over the vectors, which are never shuffled; only k rows
  per query and block reach the final ranking;
* neither fits: ``cells`` splits both sides into bounded tiles and skips the tiles that
  cannot matter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from likeness.operators import blocks, cells
from likeness.operators.topn import first_per_group
from likeness.session import cut

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 16_384


def _hits_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("rank", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k nearest per query out of partial results."""
    return first_per_group(hits, ["query_id"], ["distance", "id"], k)


def dimension(vectors: DataFrame) -> int | None:
    first = vectors.select(F.size("vector").alias("d")).head(1)
    return first[0]["d"] if first else None


def held_if_small(df: DataFrame, max_rows: int) -> pa.Table | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None.

    They are counted first: a count reads no vectors, while a limit over many partitions
    would gather that many rows from each.
    """
    return df.toArrow() if df.count() <= max_rows else None


def with_k(queries: DataFrame, k: int | None) -> DataFrame:
    count = F.lit(k) if k is not None else F.col("k")
    return queries.select("query_id", "vector", count.cast("int").alias("k"))


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | None = None,
    *,
    exclude_self: bool = False,
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    n_cells: int | None = None,
    dim: int | None = None,
) -> DataFrame:
    """The k nearest vectors of each query: (query_id, rank, id, distance, similarity).

    ``queries`` has (query_id, vector) and, unless ``k`` is given, its own k;
    ``vectors`` has (id, vector). Ties go to the smaller id. ``exclude_self`` leaves out
    the row whose id equals the query_id. ``strategy`` is ``auto``, ``hold_vectors``,
    ``hold_queries`` (both still checked against the bound), ``queries_first`` (the queries
    are held if they fit the bound, else as ``cells``) or ``cells``. ``dim`` is read from the
    first vector unless given.
    """
    queries = with_k(queries, k)
    vectors = vectors.select("id", "vector")
    spark, sc = queries.sparkSession, queries.sparkSession.sparkContext
    schema = _hits_schema(queries.schema["query_id"].dataType, vectors.schema["id"].dataType)
    dim = dim or dimension(vectors)
    if dim is None:
        return with_similarity(spark.createDataFrame([], schema))
    row_bytes = 8 * max(1, dim) + 64

    if strategy in ("auto", "hold_vectors"):
        table = held_if_small(vectors, broadcast_bytes // row_bytes)
        if table is not None:
            rows = blocks.matrix(table["vector"], dim, cells.value_kind(vectors))
            most = None if k is None else k + exclude_self
            held = sc.broadcast(blocks.by_id(table["id"], rows, most))
            found = queries.mapInArrow(blocks.search_held_vectors(held, exclude_self), schema)
            return with_similarity(found)
        if strategy == "hold_vectors":
            raise ValueError("the vectors exceed broadcast_bytes")

    queries = cut(queries)
    if strategy in ("auto", "hold_queries", "queries_first"):
        # The answers of one block weigh k × 16 bytes per query and count as well.
        table = held_if_small(queries, broadcast_bytes // row_bytes)
        if table is not None and table.num_rows == 0:
            return with_similarity(spark.createDataFrame([], schema))
        if table is not None:
            ks = table["k"].to_numpy()
            if table.num_rows * (row_bytes + 16 * int(ks.max())) <= 2 * broadcast_bytes:
                rows = blocks.unit_rows(blocks.matrix(table["vector"], dim))
                held = sc.broadcast((blocks.combined(table["query_id"]), rows, ks))
                work = blocks.search_held_queries(held, block_rows, exclude_self)
                hits = rank_hits(vectors.mapInArrow(work, schema), int(ks.max()))
                own = spark.createDataFrame(table.select(["query_id", "k"]))
                return with_similarity(hits if k is not None else _own_k(hits, own))
        if strategy == "hold_queries":
            raise ValueError("the queries exceed broadcast_bytes")

    index = cells.build_cells(vectors, n_cells=n_cells, block_rows=block_rows)
    hits = cells.search(index, queries, exclude_self=exclude_self, block_rows=block_rows)
    return with_similarity(hits if k is not None else _own_k(hits, queries))


def _own_k(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Cut hits ranked up to the largest k down to each query's own."""
    own = queries.select("query_id", "k")
    return hits.join(own, "query_id").filter(F.col("rank") <= F.col("k")).drop("k")


def nearest_in_cells(
    index: cells.Cells, queries: DataFrame, k: int, probes: int | None = None, **options
) -> DataFrame:
    """Search an index that is there already: exact, or approximate with ``probes``."""
    return with_similarity(cells.search(index, cut(with_k(queries, k)), probes=probes, **options))


def with_similarity(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "id", "distance", (1 - F.col("distance")).alias("similarity")
    )


def neighbours_of_all(vectors: DataFrame, k: int, **options) -> DataFrame:
    """Each vector's k nearest others."""
    queries = vectors.select(F.col("id").alias("query_id"), "vector")
    return nearest(queries, vectors, k, exclude_self=True, **options)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: how many of the exact hits were found, and their share."""
    marks = found.select("query_id", "id", F.lit(1).alias("hit"))
    counts = exact.join(marks, ["query_id", "id"], "left").agg(
        F.count("*").alias("exact_hits"), F.count("hit").alias("found_hits")
    )
    return counts.withColumn("recall", F.try_divide("found_hits", "exact_hits"))
