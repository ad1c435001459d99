"""Approximate search that is asked for a recall and not for a number of cells.

How many cells a search has to look into depends on how the vectors lie. So some queries are
drawn and answered exactly first, in one pass over the vectors; where their true neighbours
lie tells which number of nearest cells is enough. Where that number holds too large a part of
all rows, as it does when the vectors form no groups, looking into cells saves nothing, and
the search goes the exact way and says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.operators import blocks, cells, neighbours
from likeness.session import cut

# Queries that are answered exactly to learn from; they come to the driver.
DRAWN = 256
# A part of all rows beyond which cells are not worth their shuffle.
EXACT_SHARE = 0.5
# Standard errors that the recall of the drawn queries has to lie above the target.
ERRORS = 2.0


@dataclass(frozen=True)
class Calibration:
    """What the drawn queries showed: with ``probes`` cells each, the part of their true
    neighbours that lies in them, its standard error, and the part of all rows looked at.
    ``exact`` says that the cells are not used."""

    cells: int
    drawn: int
    probes: int
    recall: float
    error: float
    share: float
    exact: bool


def draw(queries: DataFrame, n: int = DRAWN) -> DataFrame:
    """``n`` queries of the smallest hash, all if fewer. The hash leaves some eight times as
    many as are wanted before any is ordered."""
    digest = F.sha2(F.concat(F.lit("drawn:"), F.col("query_id").cast("string")), 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    some = queries.filter(place <= 8.0 * n / max(1, queries.count()))
    return some.orderBy(digest, "query_id").limit(n)


def turns(vectors: np.ndarray, index: cells.Cells, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(turn, held): for each vector and cell its place, from 0, in the order of visits, and for
    each vector and place the rows of all cells up to it. Cells without rows are not visited."""
    angle = blocks.angles(blocks.unit_rows(vectors), index.pivots)
    angle[:, count == 0] = np.inf
    order = np.argsort(angle, axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return turn, np.cumsum(count[order], axis=1)


def calibrate(
    index: cells.Cells,
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    recall: float = 0.9,
    drawn: int = DRAWN,
    exact_share: float = EXACT_SHARE,
    exclude_self: bool = False,
) -> Calibration:
    """The least number of cells with which the drawn queries find the asked part of their k
    nearest, by ERRORS standard errors. ``index`` is over ``vectors``; without queries or rows
    there is nothing to learn, and the search is exact."""
    some = cut(draw(queries.select("query_id", "vector"), drawn))
    table = some.orderBy("query_id").toArrow()  # at most ``drawn`` rows
    count, _ = cells.cell_facts(index)
    total, n_cells = int(count.sum()), len(index.pivots)
    if not table.num_rows or not total:
        return Calibration(n_cells, 0, n_cells, 1.0, 0.0, 1.0, True)
    truth = neighbours.nearest(some, vectors, k, exclude_self=exclude_self).select("query_id", "id")
    homes = index.assigned.select("id", "cell").join(F.broadcast(truth), "id")
    at = {q: i for i, q in enumerate(table["query_id"].to_pylist())}
    homes = [(at[r["query_id"]], r["cell"]) for r in homes.select("query_id", "cell").collect()]
    if not homes:
        return Calibration(n_cells, table.num_rows, n_cells, 1.0, 0.0, 1.0, True)
    asked, home = np.array(homes).T
    rows, place = blocks.matrix(table["vector"]), np.empty(len(asked), np.int64)
    share = np.zeros(n_cells)
    step = max(1, blocks.MATRIX_CELLS // n_cells)
    for start in range(0, len(rows), step):
        turn, held = turns(rows[start : start + step], index, count)
        share += held.sum(axis=0) / total
        here = (asked >= start) & (asked < start + len(turn))
        place[here] = turn[asked[here] - start, home[here]]
    # The part found grows only where a cell holds a true neighbour.
    places = np.unique(place)
    found = np.zeros((len(rows), len(places)))
    np.add.at(found, (asked, np.searchsorted(places, place)), 1)
    wanted = found.sum(axis=1, keepdims=True)
    part = np.where(wanted > 0, np.cumsum(found, axis=1) / np.maximum(1, wanted), 1.0)
    mean, error = part.mean(axis=0), part.std(axis=0) / math.sqrt(len(part))
    best = int(np.argmax(mean - ERRORS * error >= recall))  # the last place has all
    looked = float(share[places[best]] / len(rows))
    return Calibration(
        n_cells, len(rows), int(places[best]) + 1, float(mean[best]), float(error[best]), looked,
        looked > exact_share,
    )


def cells_for(vectors: DataFrame, n_cells: int | None = None) -> cells.Cells:
    """Cells for approximate search: the root of the number of rows, so that choosing cells and
    looking into one cost about the same, as far as the pivots can be held by every task."""
    if n_cells is None:
        dim = neighbours.dimension(vectors) or 1
        n_cells = max(1, min(math.ceil(math.sqrt(vectors.count())), cells.PIVOT_BYTES // (8 * dim)))
    return cells.build_cells(vectors, n_cells=n_cells)


def approximate(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    recall: float = 0.9,
    index: cells.Cells | None = None,
    exclude_self: bool = False,
    drawn: int = DRAWN,
    exact_share: float = EXACT_SHARE,
) -> tuple[DataFrame, Calibration]:
    """Hits (query_id, rank, id, distance, similarity) with at least about the asked recall, and
    how it was made sure. An ``index`` that is there already is used as it is."""
    queries, vectors = queries.select("query_id", "vector"), vectors.select("id", "vector")
    if not vectors.head(1):
        return neighbours.nearest(queries, vectors, k), Calibration(0, 0, 0, 1.0, 0.0, 1.0, True)
    index = index or cells_for(vectors)
    how = calibrate(
        index, queries, vectors, k,
        recall=recall, drawn=drawn, exact_share=exact_share, exclude_self=exclude_self,
    )
    if how.exact:
        return neighbours.nearest(queries, vectors, k, exclude_self=exclude_self), how
    return neighbours.nearest_in_cells(index, queries, k, how.probes, exclude_self=exclude_self), how


def as_table(spark, how: Calibration) -> DataFrame:
    """The calibration as one row."""
    schema = "cells int, drawn int, probes int, recall double, error double, share double, exact boolean"
    row = (how.cells, how.drawn, how.probes, how.recall, how.error, how.share, how.exact)
    return spark.createDataFrame([row], schema)
