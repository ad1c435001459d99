"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Items are dealt into shards of bounded size. In a shard the postings of each dimension are
cut into segments of equal impact (the size of the component). A block of queries takes
the segments in descending order of impact times the block's largest weight there, and
adds what each posting contributes. What is still to come for an item is bounded by the
norm of its components not yet seen, so at any point each score lies between two bounds.
The block stops only when the bounds prove that few items can still be among the k best;
those are scored again exactly. The shards' lists are then merged.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.common import key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_ROWS = 8192
# Queries that meet a shard in one task, and those that go through its segments together.
QUERY_ROWS = 2048
BLOCK = 256
# Shares of the postings after which the bounds are looked at, and the share of the items
# that may be scored again when the block stops there.
STOPS = (0.6, 0.8)
FEW = 0.05
PAIRS = 1 << 18


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    rows = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(rows, vectors, strict=True):
        row[: len(vector)] = vector
    return rows


class Index:
    """Postings of a shard's items, in segments of one dimension and impact."""

    def __init__(self, items: np.ndarray):
        self.items = items
        self.segments: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for dimension, column in enumerate(items.T):
            size = np.abs(column)
            order = np.argsort(-size, kind="stable")
            order = order[: int(np.count_nonzero(size))]
            for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                if len(rows):
                    self.segments.append((dimension, int(size[rows[0]]), rows, column[rows]))
        self.postings = sum(len(s[2]) for s in self.segments)
        self.norms = (items.astype(np.float64) ** 2).sum(axis=1)

    def best(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of every item that may be among the k best, exactly scored."""
        weight = np.abs(queries).max(axis=0, initial=0)
        turn = sorted(self.segments, key=lambda s: -s[1] * int(weight[s[0]]))
        most = float(weight.max(initial=0)) * np.abs(self.items).max(initial=0)
        kind = np.int32 if most * self.items.shape[1] < 2**30 else np.int64
        scores = np.zeros((len(self.items), len(queries)), kind)
        by_dimension = queries.T.astype(kind)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        rest, seen, stops = self.norms.copy(), 0, [s * self.postings for s in STOPS]
        for dimension, _, rows, values in turn:
            if weight[dimension]:
                scores[rows] += values[:, None].astype(kind) * by_dimension[dimension]
            rest[rows] -= values.astype(np.float64) ** 2
            seen += len(rows)
            if stops and seen >= stops[0]:
                stops.pop(0)
                possible = self.possible(scores, rest, norms, k)
                if possible.sum() <= max(FEW * possible.size, 2 * k * len(queries)):
                    break
        else:
            possible = self.possible(scores, rest * 0, norms, k)
        item, query = np.nonzero(possible)
        exact = np.empty(len(item), np.int64)
        for at in range(0, len(item), PAIRS):
            some = slice(at, at + PAIRS)
            exact[some] = (self.items[item[some]] * queries[query[some]]).sum(axis=1)
        return query, item, exact

    @staticmethod
    def possible(scores, rest, norms, k) -> np.ndarray:
        """Which items may be among the k best, ties included: their upper bound reaches
        the k-th largest lower bound."""
        if len(scores) <= k:
            return np.ones(scores.shape, bool)
        # Half a point more than rounding can take away; scores are whole numbers.
        slack = np.sqrt(np.maximum(rest, 0.0))[:, None] * norms[None, :] * (1 + 1e-9) + 0.25
        lower = scores - slack
        least = np.partition(lower, len(lower) - k, axis=0)[len(lower) - k]
        return scores + slack >= least


def whole_vectors(df: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """(id, vector of longs): floor(scale * x) of each component. Vectors that are null or
    hold null, NaN or infinite components are left out, and so are rows without id; of
    rows with one id the greatest vector stays."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    floors = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    kept = df.filter(F.col(id).isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.groupBy(F.col(id).cast("long").alias("id")).agg(F.max(floors).alias("vector"))


def top_k(
    items: DataFrame,
    queries: Column,
    k: int,
    id: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``items`` that ``queries`` holds for, the
    k other rows with the highest inner products of floor(scale * x), all of them if there
    are fewer. Ties go to the smaller id; ranks count from 1.

    See ``whole_vectors`` for rows that take no part. Vectors of different length are
    compared as if the shorter one ended in zeros. A vector that many rows share is no hot
    key: rows are dealt out by id. Other columns are left out.
    """
    whole = whole_vectors(items, key(id), key(vector), scale)
    asked = whole_vectors(items.filter(queries), key(id), key(vector), scale)
    shards = max(1, -(-whole.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def dealt(of: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")

    def every(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    left = whole.select("id", "vector", dealt(shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("id", "vector", every(shards).alias("shard"), dealt(blocks).alias("block"))

    def search(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "id", "score"]
        if not len(items) or not len(asked):
            return pd.DataFrame({name: np.zeros(0, np.int64) for name in names})
        items = items.sort_values("id")
        width = max(map(len, [*items["vector"], *asked["vector"]]))
        index = Index(matrix(items["vector"], width))
        rows, wanted = items["id"].to_numpy(), matrix(asked["vector"], width)
        found = []
        for at in range(0, len(wanted), BLOCK):
            # One more, since the query's own row may be among them.
            query, item, score = index.best(wanted[at : at + BLOCK], k + 1)
            own = asked["id"].to_numpy()[at + query]
            other = own != rows[item]
            query, item, score = query[other], item[other], score[other]
            order = np.lexsort((item, -score, query))
            query, item, score = query[order], item[order], score[order]
            first = np.searchsorted(query, query, side="left")
            kept = np.arange(len(query)) - first < k
            found.append((asked["id"].to_numpy()[at + query[kept]], rows[item[kept]], score[kept]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    keys = ("shard", "block")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "query_id long, id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")
