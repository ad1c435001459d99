"""SimHash near-duplicates found with vantage-point trees.

Fingerprints that differ in at most ``RADIUS`` bits differ in at most RADIUS // SPACES bits
of one of SPACES disjoint sets of bits. In each of these spaces the Hamming distance is a
metric, and a vantage-point tree partitions the fingerprints by their distance to vantage
points: those nearer than the median go left, the others right. The tree's leaves are the
shards. By the triangle inequality a fingerprint can only be near another one of a branch
if its distance to the vantage point is within the small radius of the branch's, so it is
sent to its own shard and to those beyond whose boundary its ball reaches. Each shard goes
on with a tree of its own down to small leaves, where pairs are compared on all 64 bits.
The search is exact: the trees only decide what is not compared.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from likeness.llm.common import key, spare
from likeness.llm.components import connected
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 4
SEED = 42
RADIUS = 4
SPACES = 3
# Fingerprints a shard should have as its own; the trees are fitted on a sample of so many
# fingerprints a shard, and of MOST_SAMPLE at most.
SHARD_ROWS = 8192
SAMPLE_ROWS = 64
MOST_SAMPLE = 262_144
# Below so many fingerprints a branch is compared pair by pair, so many pairs at once.
LEAF_ROWS = 256
PAIRS = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of the whole text."""
    import xxhash

    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashed = (xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends))  # noqa: B905
    values = np.fromiter(hashed, np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        bits = values[at : at + (1 << 15)].astype("<u8").view("u1").reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    chosen = np.packbits(2 * counts > len(values), bitorder="little")
    return int(chosen.view("<i8")[0])


def masks(spaces: int = SPACES) -> list[int]:
    """Disjoint sets of bits that make up all 64."""
    cuts = [round(64 * k / spaces) for k in range(spaces + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


def apart(values: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((values ^ point) & mask).astype(np.int64)


def vantage(values: np.ndarray, mask: np.uint64, radius: int):
    """The vantage point and threshold, out of a few, whose halves are near enough equal and
    whose boundary the fewest balls cross; None where no point tells the values apart."""
    best = None
    for k in np.linspace(0, len(values) - 1, 7).astype(int):
        d = apart(values, values[k], mask)
        for threshold in {int(np.median(d)), int(np.median(d)) - 1}:
            inner = int((d <= threshold).sum())
            if inner in (0, len(d)):
                continue
            crossing = int(((d > threshold - radius) & (d <= threshold + radius)).sum())
            cost = crossing + abs(2 * inner - len(d))
            if best is None or cost < best[0]:
                best = (cost, values[k], threshold)
    return best and best[1:]


class Tree:
    """A vantage-point tree over a sample; its leaves are numbered."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaves: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.nodes: list = []  # (vantage point, threshold, left, right) or a leaf's number
        self.leaves = 0
        depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.grow(sample, depth)

    @classmethod
    def known(cls, nodes: list, mask: int, radius: int) -> Tree:
        tree = cls(np.zeros(0, np.uint64), mask, radius, 1)
        tree.nodes = nodes
        return tree

    def grow(self, values: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        chosen = vantage(values, self.mask, self.radius) if depth and len(values) > 1 else None
        if chosen is None:
            self.nodes[at] = self.leaves
            self.leaves += 1
            return at
        point, threshold = chosen
        inner = apart(values, point, self.mask) <= threshold
        left = self.grow(values[inner], depth - 1)
        self.nodes[at] = (point, threshold, left, self.grow(values[~inner], depth - 1))
        return at

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, leaf, whether it is the own leaf): the own leaf of each value, and the
        leaves of greater number that its ball reaches."""
        found, own = [], np.zeros(len(values), np.int64)
        stack = [(0, np.arange(len(values)), np.ones(len(values), bool))]
        while stack:
            at, rows, home = stack.pop()
            node = self.nodes[at]
            if not len(rows):
                continue
            if not isinstance(node, tuple):
                own[rows[home]] = node
                found.append((rows, np.full(len(rows), node), home))
                continue
            point, threshold, left, right = node
            d = apart(values[rows], point, self.mask)
            inner, outer = d - self.radius <= threshold, d + self.radius > threshold
            stack.append((left, rows[inner], home[inner] & (d <= threshold)[inner]))
            stack.append((right, rows[outer], home[outer] & (d > threshold)[outer]))
        rows, leaf, home = (np.concatenate(c) for c in zip(*found)) if found else ([], [], [])  # noqa: B905
        rows, leaf, home = np.asarray(rows, np.int64), np.asarray(leaf, np.int64), np.asarray(home, bool)
        keep = home | (leaf > own[rows])
        return rows[keep], leaf[keep], home[keep]


class Groups:
    """Labels of points, joined by pairs many at a time."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.label[a], self.label[b]
            other = a != b
            if not other.any():
                return
            a, b = a[other], b[other]
            low, high = np.minimum(a, b), np.maximum(a, b)
            root = np.arange(len(self.label))
            np.minimum.at(root, high, low)
            while True:
                further = root[root]
                if (further == root).all():
                    break
                root = further
            self.label = root[self.label]


def linked(
    values: np.ndarray,
    own: np.ndarray,
    mask: int,
    small: int,
    radius: int,
) -> np.ndarray:
    """Labels of the values after joining all pairs of an own value and any value that
    differ in at most ``radius`` bits, and in at most ``small`` bits of ``mask``."""
    groups, mask = Groups(len(values)), np.uint64(mask)
    stack = [(np.flatnonzero(own), np.arange(len(values)))]
    while stack:
        kept, asked = stack.pop()
        if not len(kept) or not len(asked):
            continue
        chosen = vantage(values[kept], mask, small) if len(kept) > LEAF_ROWS else None
        if chosen is None:
            step = max(1, PAIRS // len(kept))
            for at in range(0, len(asked), step):
                some = asked[at : at + step]
                far = np.bitwise_count(values[some][:, None] ^ values[kept][None, :])
                x, y = np.nonzero(far <= radius)
                groups.join(some[x], kept[y])
            continue
        point, threshold = chosen
        d, q = apart(values[kept], point, mask), apart(values[asked], point, mask)
        stack.append((kept[d <= threshold], asked[q - small <= threshold]))
        stack.append((kept[d > threshold], asked[q + small > threshold]))
    return groups.label


def links(
    prints: DataFrame,
    radius: int = RADIUS,
    spaces: int = SPACES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``prints`` (fingerprint, node; fingerprints are
    distinct) just as all pairs within the radius do. A shard sends one edge for each node
    that it joins to another, not one for each pair."""
    spark, small = prints.sparkSession, radius // spaces
    shards = -(-prints.count() // shard_rows)
    wanted = min(MOST_SAMPLE, SAMPLE_ROWS * shards)
    drawn = prints.select("fingerprint", F.xxhash64("fingerprint").alias("h"))
    drawn = drawn.orderBy("h", "fingerprint").limit(wanted).collect()
    sample = np.array([r.fingerprint for r in drawn], np.int64).view(np.uint64)
    # At most 4 * MOST_SAMPLE / SAMPLE_ROWS nodes a tree.
    fitted = [Tree(sample, mask, small, shards) for mask in masks(spaces)]
    nodes = spark.sparkContext.broadcast([tree.nodes for tree in fitted])

    def deal(frames):
        trees = [Tree.known(*t, small) for t in zip(nodes.value, masks(spaces), strict=True)]
        for frame in frames:
            values = frame["fingerprint"].to_numpy(np.int64).view(np.uint64)
            for space, tree in enumerate(trees):
                rows, leaf, own = tree.shards(values)
                yield pd.DataFrame(
                    {
                        "space": np.full(len(rows), space, np.int32),
                        "shard": leaf,
                        "own": own,
                        "fingerprint": frame["fingerprint"].to_numpy()[rows],
                        "node": frame["node"].to_numpy()[rows],
                    }
                )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        node = frame["node"].to_numpy()
        values = frame["fingerprint"].to_numpy(np.int64).view(np.uint64)
        mask = masks(spaces)[int(frame["space"].iloc[0])]
        label = linked(values, frame["own"].to_numpy(bool), mask, small, radius)
        other = label != np.arange(len(label))
        return pd.DataFrame({"a": node[other], "b": node[label[other]]})

    kinds = "space int, shard long, own boolean, fingerprint long, node long"
    dealt = prints.mapInPandas(deal, kinds)
    return dealt.groupBy("space", "shard").applyInPandas(search, "a long, b long")


def with_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    spaces: int = SPACES,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, fingerprint, component_id) for every row: the fingerprint as 16 lowercase hex
    digits, and the smallest id that can be reached over links, the own one included.

    Texts without words, null ones too, have fingerprint zero and are linked like others.
    Rows without id take no part: their component is null. Rows with equal ids are linked
    as their fingerprints are, through the id as well. Other columns are left out. Equal
    fingerprints are reduced to their smallest id before anything is compared.
    """

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    body, own = F.col(key(text)), F.col(key(id)).cast("long").alias("id")
    each = cut(docs.select(own, prints(body).alias("fingerprint")))
    named = each.filter("id IS NOT NULL")
    nodes = cut(named.groupBy("fingerprint").agg(F.min("id").alias("node")))
    # An id with several texts ties their fingerprints together.
    several = named.groupBy("id").agg(
        F.min("fingerprint").alias("x"), F.max("fingerprint").alias("y")
    )
    several = several.filter("x <> y").select("id")
    tied = named.join(several, "id").join(nodes, "fingerprint")
    tied = tied.select(F.col("id").alias("a"), F.col("node").alias("b"))
    near = links(nodes, radius, spaces, shard_rows)
    reached = connected(near.union(tied)).withColumnRenamed("node", "of")
    known = nodes.join(reached, nodes["node"] == reached["of"], "left").select(
        F.col("fingerprint").alias("known"), F.coalesce("component", "node").alias("component")
    )
    found = each.join(known, each["fingerprint"] == known["known"], "left")
    return found.select(
        F.col("id").alias(id),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns; of rows
    with one id, the first by a hash of the text. Rows without id stay. ``how`` goes to
    ``with_groups``."""
    lost, rank = spare(docs, "lost"), spare(docs, "rank")
    groups = with_groups(docs, id, text, **how)
    others = groups.filter(F.col(key(id)) != F.col("component_id"))
    others = others.select(F.col(key(id)).alias(lost)).distinct()
    left = docs.join(others, docs[key(id)] == others[lost], "left_anti")
    first = Window.partitionBy(key(id)).orderBy(F.xxhash64(key(text)), key(text))
    ranked = left.withColumn(rank, F.row_number().over(first))
    kept = ranked.filter((F.col(rank) == 1) | F.col(key(id)).isNull())
    return kept.select(*[key(c) for c in docs.columns])
