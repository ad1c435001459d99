"""Vectors grouped around pivots, and searches that visit only some of the groups.

An exact search skips a cell when the triangle inequality on angles shows that none of
its rows can be among the k nearest (the kNN join by pivots known from the literature);
an approximate one visits a fixed number of cells. Cells and the queries that visit them
are cut into tiles of bounded size, so a cell holding a third of all rows, or visited by
all queries, is many tasks and not one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from likeness.operators import blocks
from likeness.operators.topn import first_per_group
from likeness.session import cut

# What the pivots, which every task holds, may weigh; more cells are an error.
PIVOT_BYTES = 256 * 1024 * 1024
# Rows of a cell that are written to one file.
FILE_ROWS = 1_000_000
# Distances that tie at 12 decimals may lie 1.5e-6 apart as angles, and angles near 0
# carry an error of about 1e-8; cells within the slack are visited too.
ANGLE_SLACK = 3e-6
# Copies that tiles may make of a row on the average, and what all copies may weigh at any rate.
COPIES = 2
COPY_BYTES = 256 * 1024 * 1024
# What the vectors of one tile may weigh as doubles, and its queries and their hits.
MEMBER_BYTES = 64 * 1024 * 1024
GUEST_BYTES = 128 * 1024 * 1024
HIT_BYTES = 32


@dataclass(frozen=True)
class Cells:
    """``pivots`` are unit rows on the driver (PIVOT_BYTES at most); ``assigned`` has
    (id, packed, cell, angle), where ``packed`` are the raw values of a vector, of the
    numpy kind ``kind``."""

    pivots: np.ndarray
    assigned: DataFrame
    kind: str


def value_kind(df: DataFrame) -> str:
    """The numpy kind of the values in the column ``vector``."""
    return "<f4" if df.schema["vector"].dataType.elementType == T.FloatType() else "<f8"


def sample_pivots(vectors: DataFrame, n: int, total: int) -> np.ndarray:
    """About ``n`` of ``total`` rows chosen by a hash of their id, equal rows once.

    The hash leaves some eight times as many rows as are wanted, so that ordering them
    does not gather ``n`` rows from every partition.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
    some = vectors.filter(place <= 8.0 * n / max(1, total))
    rows = some.orderBy(digest, "id").limit(n).collect()
    if not rows:
        rows = vectors.limit(1).collect()
    unit = blocks.unit_rows(np.array([r["vector"] for r in rows], dtype=np.float64))
    _, first = np.unique(np.round(unit, 9), axis=0, return_index=True)
    return unit[np.sort(first)]


def kmeans_pivots(vectors: DataFrame, n: int, seed: int = 7) -> np.ndarray:
    """Cluster centres, learned by Spark's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # Stored, as every round of the learning reads it.
    points = cut(vectors.select("vector")).select(array_to_vector("vector").alias("features"))
    model = KMeans(k=n, seed=seed, distanceMeasure="cosine").fit(points)
    return blocks.unit_rows(np.array(model.clusterCenters()))


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, packed, cell, angle): the nearest pivot and the angle to it; no shuffle."""
    if pivots.nbytes > PIVOT_BYTES:
        raise ValueError(f"{len(pivots)} pivots exceed {PIVOT_BYTES} bytes: ask for fewer cells")
    held = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(
        [
            vectors.schema["id"],
            T.StructField("packed", T.BinaryType()),
            T.StructField("cell", T.IntegerType()),
            T.StructField("angle", T.DoubleType()),
        ]
    )
    return vectors.mapInArrow(blocks.nearest_pivot(held, value_kind(vectors)), schema)


def build_cells(
    vectors: DataFrame,
    *,
    n_cells: int | None = None,
    pivots: np.ndarray | None = None,
    block_rows: int = 16_384,
) -> Cells:
    """Cells around given pivots, or around ``n_cells`` sampled ones: as many as the rows
    make blocks, but no more than the root of the number of rows, where the cost of
    choosing cells and that of looking into one are in balance, and no more than every task
    can hold; cells only become larger then. The assignment is stored, since a search reads
    it several times."""
    vectors = vectors.select("id", "vector")
    if pivots is None:
        total = vectors.count()
        first = vectors.select(F.size("vector").alias("d")).head(1)
        held = PIVOT_BYTES // (8 * max(1, first[0]["d"] if first else 1))
        n = n_cells or max(1, min(math.ceil(min(total / block_rows, math.sqrt(total))), held))
        pivots = sample_pivots(vectors, n, total)
    return Cells(pivots, cut(assign(vectors, pivots)), value_kind(vectors))


def add_rows(index: Cells, vectors: DataFrame) -> Cells:
    """The index with further rows, or other vectors of rows it has; pivots stay."""
    if value_kind(vectors) != index.kind:
        raise ValueError(f"the values of the index are {index.kind}")
    fresh = cut(assign(vectors.select("id", "vector"), index.pivots))
    kept = index.assigned.join(fresh.select("id"), "id", "left_anti")
    return Cells(index.pivots, kept.unionByName(fresh), index.kind)


def write_cells(index: Cells, path: str) -> None:
    """Keep the assignment, one folder per cell, so that later searches skip folders. A
    folder has one file for each FILE_ROWS rows or so of the largest cell."""
    count, _ = cell_facts(index)
    salt = F.pmod(F.xxhash64("id"), F.lit(math.ceil(max(1, int(count.max())) / FILE_ROWS)))
    spread = index.assigned.repartition("cell", salt)
    spread.write.partitionBy("cell").parquet(f"{path}/members")
    spark = index.assigned.sparkSession
    rows = [(i, [float(x) for x in p], index.kind) for i, p in enumerate(index.pivots)]
    pivots = spark.createDataFrame(rows, "cell int, pivot array<double>, kind string")
    pivots.coalesce(1).write.parquet(f"{path}/pivots")


def read_cells(spark, path: str) -> Cells:
    rows = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
    pivots = np.array([r["pivot"] for r in rows])
    members = spark.read.parquet(f"{path}/members")
    return Cells(pivots, members.select("id", "packed", "cell", "angle"), rows[0]["kind"])


def cell_facts(index: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Arrays over cells: their rows and their radius. One row per pivot is fetched."""
    sizes = index.assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r"))
    count, radius = np.zeros(len(index.pivots), np.int64), np.zeros(len(index.pivots))
    for row in sizes.collect():
        count[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    return count, radius


def visits(
    index: Cells, queries: DataFrame, facts, probes: int | None, kind: str | None = None, homes=None
) -> DataFrame:
    """(query_id, k, reach[, packed], cell): the cells each query has to look into, or the
    ``homes`` of these, each once."""
    held = queries.sparkSession.sparkContext.broadcast((index.pivots, *facts, homes))
    names = ["query_id", "k", "reach"]
    fields = [queries.schema[name] for name in names]
    fields += [T.StructField("packed", T.BinaryType())] if kind else []
    schema = T.StructType([*fields, T.StructField("cell", T.IntegerType())])
    work = blocks.visited_cells(held, probes, ANGLE_SLACK, kind)
    return queries.select("vector", *names).mapInArrow(work, schema)


def search(
    index: Cells,
    queries: DataFrame,
    *,
    probes: int | None = None,
    exclude_self: bool = False,
    block_rows: int = 16_384,
) -> DataFrame:
    """The nearest rows (query_id, rank, id, distance) of queries (query_id, vector, k).

    With ``probes`` each query looks into that many cells. Without, the search is exact:
    it first looks into the nearest cells that hold k rows, which gives every query the
    distance its k nearest cannot exceed, and then into all cells that may have a row
    within it. The queries are read several times and should be a stored table.
    """
    facts = cell_facts(index)
    k_max = queries.agg(F.max("k")).head()[0] or 1
    # With its own row left out a query needs one row more to be sure of k.
    asked = queries.withColumn("k", F.col("k") + int(exclude_self))
    asked = asked.withColumn("reach", F.lit(float("inf")))
    options = {"exclude_self": exclude_self, "block_rows": block_rows}
    near = _search_tiles(index, asked, facts, probes, **options)
    ranked = first_per_group(near, ["query_id"], ["distance", "id"], k_max)
    if probes is not None:
        return ranked
    # Fewer than k hits, as there are fewer rows, leave nothing out of reach: 2 is all.
    reach = F.when(F.count("*") >= F.col("k"), F.max("distance")).otherwise(F.lit(2.0))
    own = queries.select("query_id", "k")
    bounds = (
        ranked.join(own, "query_id")
        .filter(F.col("rank") <= F.col("k"))
        .groupBy("query_id", "k")
        .agg(reach.alias("reach"))
        .select("query_id", "reach")
    )
    bounded = asked.drop("reach").join(bounds, "query_id", "left")
    bounded = cut(bounded.withColumn("reach", F.coalesce("reach", F.lit(2.0))))
    found = _search_tiles(index, bounded, facts, None, **options)
    return first_per_group(found, ["query_id"], ["distance", "id"], k_max)


def _search_tiles(
    index: Cells,
    queries: DataFrame,
    facts,
    probes: int | None,
    *,
    exclude_self: bool,
    block_rows: int,
) -> DataFrame:
    """Partial hits (query_id, rank, id, distance): the nearest rows of each tile."""
    spark, dim = queries.sparkSession, index.pivots.shape[1]
    kinds = value_kind(queries), index.kind
    guest_bytes, member_bytes = (np.dtype(kind).itemsize * dim + 64 for kind in kinds)
    most_members = MEMBER_BYTES // (8 * dim)
    asked = queries.agg(F.count("*").alias("n"), F.max("k").alias("k")).head()
    members, homes = facts[0], None
    guests = _guests(visits(index, queries, facts, probes), len(members))
    # A fixed number of cells is what an approximate search is asked for; these stay apart.
    if probes is None and guests.sum() > COPIES * asked["n"] and guests.sum() * guest_bytes > COPY_BYTES:
        wanted = COPIES * asked["n"] * len(members) // int(guests.sum())
        homes = joint_cells(index.pivots, max(math.ceil(members.sum() / most_members), int(wanted)))
        members = np.bincount(homes, members, len(members)).astype(np.int64)
        guests = _guests(visits(index, queries, facts, probes, homes=homes), len(members))
    most_guests = GUEST_BYTES // (guest_bytes + HIT_BYTES * ((asked["k"] or 1) + exclude_self))
    cut_members, cut_guests = tile_cuts(
        members, guests, block_rows, (max(block_rows, most_members), max(1, most_guests)), (member_bytes, guest_bytes)
    )
    # One row per pivot at most.
    cuts = [(int(c), int(cut_members[c]), int(cut_guests[c])) for c in np.flatnonzero(guests)]
    plan = F.broadcast(spark.createDataFrame(cuts, "cell int, member_cuts int, guest_cuts int"))
    assigned = index.assigned
    if homes is not None:
        rows = [(cell, int(home)) for cell, home in enumerate(homes)]
        to_home = F.broadcast(spark.createDataFrame(rows, "cell int, home int"))
        assigned = assigned.join(to_home, "cell").select("id", "packed", F.col("home").alias("cell"))
    asking = visits(index, queries, facts, probes, kinds[0], homes)
    return search_tiles(assigned, asking, plan, kinds, exclude_self=exclude_self)


def _guests(tour: DataFrame, n: int) -> np.ndarray:
    """How many queries visit each of ``n`` cells."""
    guests = np.zeros(n, np.int64)
    for row in tour.groupBy("cell").agg(F.count("*").alias("n")).collect():
        guests[row["cell"]] = row["n"]
    return guests


def joint_cells(pivots: np.ndarray, n: int) -> np.ndarray:
    """For each cell which of about ``n`` it is put together with: the nearest of as many pivots."""
    n = max(1, min(n, len(pivots)))
    homes = np.empty(len(pivots), np.int64)
    step = max(1, blocks.MATRIX_CELLS // n)
    for start in range(0, len(pivots), step):
        homes[start : start + step] = (pivots[start : start + step] @ pivots[:n].T).argmax(axis=1)
    return homes


def tile_cuts(members, guests, block_rows: int, most: tuple[int, int], weights: tuple[int, int]):
    """Into how many parts the members and the guests of each cell are cut. A member goes to all
    parts of the guests and a guest to all parts of the members, so parts of ``block_rows`` would
    multiply both sides as the tables grow: they are doubled, up to the ``most`` that a task can
    hold, until the copies weigh no more than COPIES of the rows themselves, or COPY_BYTES."""
    rows = np.minimum(block_rows, most)
    allowed = max(COPY_BYTES, COPIES * int(members.sum() * weights[0] + guests.sum() * weights[1]))
    while True:
        cuts = [np.maximum(1, -(-side // part)) for side, part in zip((members, guests), rows, strict=True)]
        here = guests > 0
        weight = (members * cuts[1] * weights[0] + guests * cuts[0] * weights[1])[here].sum()
        if weight <= allowed or (rows >= most).all():
            return cuts
        rows = np.minimum(2 * rows, most)


def search_tiles(
    members: DataFrame,
    asking: DataFrame,
    plan: DataFrame,
    kinds: tuple[str, str],
    *,
    exclude_self: bool,
) -> DataFrame:
    """Partial hits of queries (query_id, packed, k, reach, cell) among members (id, packed,
    cell). ``plan`` (cell, member_cuts, guest_cuts) says into how many parts each side of a cell
    is cut; each pair of parts is one tile. ``kinds`` are the numpy kinds of both sides."""

    def spread(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def part(key: str, count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    tile = ["cell", "member_part", "guest_part"]
    members = (
        members.select("id", "packed", "cell")
        .join(plan, "cell")
        .withColumn("member_part", part("id", "member_cuts"))
        .withColumn("guest_part", spread("guest_cuts"))
        .select(*tile, "id", "packed")
    )
    asking = (
        asking.join(plan, "cell")
        .withColumn("guest_part", part("query_id", "guest_cuts"))
        .withColumn("member_part", spread("member_cuts"))
        .select(*tile, "query_id", "packed", "k", "reach")
    )
    schema = T.StructType(
        [
            asking.schema["query_id"],
            T.StructField("rank", T.IntegerType()),
            members.schema["id"],
            T.StructField("distance", T.DoubleType()),
        ]
    )
    work = blocks.search_tile(*kinds, exclude_self, to_arrow_schema(schema))
    return asking.groupBy(*tile).cogroup(members.groupBy(*tile)).applyInArrow(work, schema)


def candidate_share(index: Cells, queries: DataFrame, probes: int, k: int) -> DataFrame:
    """One row: the pairs a search with ``probes`` looks at, all pairs, and the share."""
    facts = cell_facts(index)
    asked = queries.select(
        "query_id",
        "vector",
        F.lit(k).cast("int").alias("k"),
        F.lit(float("inf")).alias("reach"),
    )
    sizes = index.assigned.groupBy("cell").agg(F.count("*").alias("n"))
    tour = visits(index, asked, facts, probes).groupBy("cell").agg(F.count("*").alias("q"))
    total = F.lit(int(facts[0].sum()) * queries.count())
    return (
        tour.join(sizes, "cell")
        .agg(F.sum(F.col("q") * F.col("n")).alias("pairs"), total.alias("all_pairs"))
        .withColumn("candidate_share", F.try_divide("pairs", "all_pairs"))
    )
