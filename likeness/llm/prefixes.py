"""What conversations share at their beginnings: a trie of their turns.

Each distinct turn (role, text) gets a number, and a conversation becomes a sequence of numbers;
no text is moved after that. Equal sequences are reduced to one, then all are sorted and cut into
ranges of a bounded number of turns. Each range builds a ternary search tree: a node holds a
number, the branches of smaller and greater ones, and below it the tree of the next turn. The
sequences are inserted median first, so its branches are balanced. A traversal without recursion
lists the nodes, and going through the list backwards adds up members, leaves and savings.

Only prefixes of a range's first or last sequence can also be found in another range. How many
turns two neighbouring ranges have in common at their border tells which nodes these are, which
range counts such a node as its own, and whether a last sequence goes on in the next range. With
that, what the ranges found for one node only has to be added.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from likeness.llm.common import key
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Turns of a range, all distinct sequences together.
SHARD_TURNS = 200_000
# Ids of conversations that are written as one text before they are hashed: 2^ID_BITS at most.
ID_BITS = 12
# Conversations of so many ids begin with the same turns, fewer than MOST_SHARED.
BLOCK = 100
MOST_SHARED = 6
NOTHING = sha256(b"").hexdigest()

SEQUENCES = "shard int, ids array<long>, chars array<int>, conv_id long, n long, ends_sha256 string"
NODES = (
    "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, counted long, own long, ends_sha256 string"
)


def numbered_turns(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, at, id, chars): the place of each turn from 1, its number and its text's length.
    The numbers belong to distinct turns; they have no order. Texts are shuffled once, to bring
    the turns of a conversation in order; turns are told apart by SHA-256."""
    empty = F.lit("")
    named = rows.select(
        F.col(key(id)).cast("long").alias("conv"),
        F.col(key(turn)).alias("turn"),
        F.coalesce(F.col(key(role)).cast("string"), empty).alias("role"),
        F.coalesce(F.col(key(text)).cast("string"), empty).alias("text"),
    ).filter("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    whole = F.concat_ws(":", F.length("role"), "role", "text")
    placed = cut(
        named.select(
            "conv",
            F.row_number().over(order).alias("at"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
            F.length("text").alias("chars"),
        )
    )
    known = placed.select("digest").distinct()
    known = cut(known.withColumn("id", F.monotonically_increasing_id()))
    return placed.join(known, "digest").select("conv", "at", "id", "chars")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, seq): each conversation's turns, the first ones taken from conversation
    ``conv - conv % BLOCK``; ``seq`` is an array of (id, chars). A conversation that is there
    stays, even without turns."""
    turn = F.struct("at", "id", "chars")
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("seq"))
    slim = F.transform("seq", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars")))
    whole = cut(whole.select("conv", slim.alias("seq")))
    first = whole.filter(F.col("conv") % BLOCK == 0).select(
        F.col("conv").alias("head"), F.slice("seq", 1, MOST_SHARED - 1).alias("first")
    )
    own = whole.withColumn("base", F.col("conv") - F.col("conv") % BLOCK)
    both = own.join(first, own["base"] == first["head"], "left")
    shared = shared_turns(F.col("conv"))
    none = F.slice("seq", 1, 0)
    seq = F.concat(
        F.slice(F.coalesce("first", none), F.lit(1), shared),
        F.slice("seq", shared + 1, F.greatest(F.size("seq"), F.lit(1))),
    )
    return both.select("conv", seq.alias("seq"))


def ranges(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """Distinct sequences in sorted ranges, as SEQUENCES: the smallest conversation of each,
    their number, and the digest of all their ids.

    Ids are written as one text for each sequence and block of ids, then hashed one text after
    the other as the rows come by, so copies of one conversation need no memory."""
    block = F.shiftright("conv", ID_BITS)
    blocks = sequences.groupBy("seq", block.alias("block")).agg(
        F.sort_array(F.collect_list("conv")).alias("convs")
    )
    blocks = cut(
        blocks.select(
            F.transform("seq", lambda t: t["id"]).alias("ids"),
            F.transform("seq", lambda t: t["chars"]).alias("chars"),
            "block",
            F.element_at("convs", 1).alias("conv_id"),
            F.size("convs").cast("long").alias("n"),
            F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("told"),
        )
    )
    (size,) = blocks.agg(F.sum(F.size("ids") + 1)).first()
    shards = max(1, -(-(size or 0) // shard_turns))
    dealt = blocks.repartitionByRange(shards, "ids").sortWithinPartitions("ids", "block")
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    target = to_arrow_schema(T._parse_datatype_string(SEQUENCES))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None

        def table(done):
            columns = zip(*done, strict=True)
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for batch in batches:
            done = []
            columns = [batch.column(name).to_pylist() for name in ("shard", "ids", "chars", "conv_id", "n", "told")]
            for shard, ids, chars, conv, n, told in zip(*columns, strict=True):
                if held is not None and held[1] == ids:
                    held[4] += n
                    state.update(b"," + told.encode())
                    continue
                if held is not None:
                    done.append((*held, state.hexdigest()))
                held, state = [shard, ids, chars, conv, n], sha256(told.encode())
            if done:
                yield table(done)
        if held is not None:
            yield table([(*held, state.hexdigest())])

    return cut(dealt.mapInArrow(hashed, SEQUENCES))


def common(a: list[int], b: list[int]) -> int:
    """How many numbers two sequences have in common at their beginning."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def borders(sequences: DataFrame) -> dict[int, int]:
    """For each range but the first, what its first sequence has in common with the last one
    before it. One number for each range comes to the driver."""
    edges = cut(sequences.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last")))
    shards = sorted(r.shard for r in edges.select("shard").collect())
    if len(shards) < 2:
        return {}
    after = edges.sparkSession.createDataFrame(list(zip(shards, shards[1:])), "shard int, next int")  # noqa: B905
    last = edges.join(after, "shard").select("next", "last")
    pairs = last.join(edges.select(F.col("shard").alias("next"), "first"), "next")

    def measured(batches):
        for batch in batches:
            nexts, lasts, firsts = (batch.column(c).to_pylist() for c in ("next", "last", "first"))
            sizes = [common(a, b) for a, b in zip(lasts, firsts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nexts, pa.int32()), pa.array(sizes, pa.int32())], names=["shard", "size"]
            )

    found = pairs.select("next", "last", "first").mapInArrow(measured, "shard int, size int")
    return {r.shard: r.size for r in found.collect()}


class Ternary:
    """A ternary search tree; node 0 is the root, which holds no number and lies above all
    others. ``below`` is the tree of the next turn, ``row`` the sequence that ends here."""

    def __init__(self):
        self.number, self.low, self.high, self.below = [None], [-1], [-1], [-1]
        self.row, self.chars = [-1], [0]

    def add(self, number: int, chars: int) -> int:
        self.number.append(number)
        self.chars.append(chars)
        for links in (self.low, self.high, self.below, self.row):
            links.append(-1)
        return len(self.number) - 1

    def insert(self, ids: list[int], chars: list[int], row: int) -> None:
        node = 0
        for number, size in zip(ids, chars, strict=True):
            links, at = self.below, node
            while True:
                found = links[at]
                if found < 0:
                    found = links[at] = self.add(number, size)
                    break
                held = self.number[found]
                if held == number:
                    break
                links, at = (self.low if number < held else self.high), found
            node = found
        self.row[node] = row

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of a sequence that was inserted, the root first."""
        nodes = [0]
        for number in ids:
            found = self.below[nodes[-1]]
            while self.number[found] != number:
                found = self.low[found] if number < self.number[found] else self.high[found]
            nodes.append(found)
        return nodes

    def listed(self) -> tuple[list[int], list[int], list[int]]:
        """(nodes, parent, depth): all nodes, each behind its parent; the others by node."""
        order, stack = [], [(0, -1, 0)]
        parent, depth = [-1] * len(self.number), [0] * len(self.number)
        while stack:
            node, above, deep = stack.pop()
            order.append(node)
            parent[node], depth[node] = above, deep
            for side in (self.low[node], self.high[node]):
                if side >= 0:
                    stack.append((side, above, deep))
            if self.below[node] >= 0:
                stack.append((self.below[node], node, deep + 1))
        return order, parent, depth


def median_first(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of every range before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack.append((middle + 1, high))
            stack.append((low, middle))


def nodes_of(table: dict[str, list], before: int | None, after: int | None) -> dict[str, list]:
    """The nodes of one range, as the columns of NODES. ``before`` and ``after`` say what its
    first sequence shares with the range before, and its last one with the next; None where
    there is no such range. Nodes that other ranges have too come with a key."""
    rows = sorted(range(len(table["ids"])), key=table["ids"].__getitem__)
    ids = [table["ids"][r] for r in rows]
    tree = Ternary()
    for at in median_first(len(rows)):
        tree.insert(ids[at], table["chars"][rows[at]], rows[at])
    order, parent, depth = tree.listed()
    size = len(order)
    # Nodes that are counted where the range before has them.
    first, last = tree.path(ids[0]), tree.path(ids[-1])
    own = [True] * size
    for node in first[: 0 if before is None else before + 1]:
        own[node] = False
    keys: dict[int, bytes] = {}
    for path, shared in ((first, before), (last, after)):
        digest = b""
        for node in path[: 0 if shared is None else shared + 1]:
            number = tree.number[node]
            digest = blake2b(digest + (b"" if number is None else number.to_bytes(8, "little", signed=True)), digest_size=16).digest()
            keys[node] = digest
    goes_on = last[-1] if after is not None and after == len(ids[-1]) else -1
    members, smallest = [0] * size, [None] * size
    children, leaves, counted, mine = ([0] * size for _ in range(4))
    ends = [NOTHING] * size
    for node in reversed(order):
        row = tree.row[node]
        if row >= 0:
            members[node] += table["n"][row]
            conv = table["conv_id"][row]
            smallest[node] = conv if smallest[node] is None else min(conv, smallest[node])
            ends[node] = table["ends_sha256"][row]
        if tree.below[node] < 0 and node != goes_on:
            leaves[node] = 1
        counted[node] += members[node] * tree.chars[node]
        mine[node] += tree.chars[node] if own[node] else 0
        above = parent[node]
        if above >= 0:
            members[above] += members[node]
            smallest[above] = smallest[node] if smallest[above] is None else min(smallest[node], smallest[above])
            children[above] += own[node]
            leaves[above] += leaves[node]
            counted[above] += counted[node]
            mine[above] += mine[node]
    up = [parent[node] for node in order]
    return {
        "key": [keys.get(node) for node in order],
        "parent_key": [keys.get(above) for above in up],
        "depth": [depth[node] for node in order],
        "conv_id": [smallest[node] for node in order],
        "parent_conv_id": [None if above < 0 or above in keys else smallest[above] for above in up],
        "n_convs": [members[node] for node in order],
        "n_children": [children[node] for node in order],
        "n_leaves": [leaves[node] for node in order],
        "counted": [counted[node] for node in order],
        "own": [mine[node] for node in order],
        "ends_sha256": [ends[node] for node in order],
    }


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of all ranges of SEQUENCES, those at borders merged."""
    shared = borders(sequences)
    later = sorted(shared)
    behind = dict(zip(later, later[1:]))  # noqa: B905
    target = to_arrow_schema(T._parse_datatype_string(NODES))
    names = target.names

    def grown(table: pa.Table) -> pa.Table:
        columns = table.to_pydict()
        shard = columns["shard"][0]
        after = behind.get(shard) if shard in shared else min(later, default=None)
        found = nodes_of(columns, shared.get(shard), shared.get(after))
        return pa.table([pa.array(found[f.name], f.type) for f in target], schema=target)

    nodes = cut(sequences.groupBy("shard").applyInArrow(grown, NODES))
    sums = [F.sum(c).alias(c) for c in names[5:10]]
    some = F.max(F.when(F.col("ends_sha256") != NOTHING, F.col("ends_sha256")))
    merged = nodes.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("parent_key").alias("parent_key"),
        F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.first("parent_conv_id").alias("parent_conv_id"),
        *sums,
        F.coalesce(some, F.lit(NOTHING)).alias("ends_sha256"),
    )
    merged = cut(merged.select(*names))
    inner = nodes.filter("key IS NULL")
    near = inner.filter("parent_key IS NOT NULL").unionByName(merged)
    above = merged.select(F.col("key").alias("above_key"), F.col("conv_id").alias("above_conv"))
    near = near.join(above, near["parent_key"] == above["above_key"], "left")
    near = near.withColumn("parent_conv_id", F.coalesce("above_conv", "parent_conv_id"))
    whole = inner.filter("parent_key IS NULL").select(*names).union(near.select(*names))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("counted") - F.col("own")).alias("saved_tokens"), "ends_sha256",
    )


def prefix_trie(
    rows: DataFrame,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations, the empty one included.

    Rows are ordered by turn, null first; rows of equal turn by role and text. A null role or
    text is empty, and rows without id take no part. Repeated rows are turns of their own, and
    conversations that are all alike are members of the same nodes. No rows give no nodes. Other
    columns are left out. A conversation is one row of numbers, 12 bytes a turn, however long
    its texts are.
    """
    turns = numbered_turns(rows, id, turn, role, text)
    return trie(ranges(rebuilt(turns), shard_turns))


def sql_trie(block: int = BLOCK, most: int = MOST_SHARED) -> str:
    """The same in DuckDB SQL. A CRC-32 is taken bit by bit; a node is the text of its turns'
    digests, and what is summed over a subtree goes from each node to all beginnings of it."""
    steps = "[-1, -1, -1, -1, -1, -1, -1, -1]"
    bits = f"""flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda c: list_concat([CAST(ascii(c) AS BIGINT)], {steps})))"""
    crc = f"""xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
        WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295)"""
    return f"""
    WITH turns AS (
      SELECT conv_id, r, t, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS place
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t
        FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (
      SELECT conv_id, conv_id - conv_id % {block} AS head, {crc} % {most} AS h
      FROM (SELECT DISTINCT conv_id FROM turns)),
    taken AS (
      SELECT c.conv_id, place, r, t FROM convs c JOIN turns t ON t.conv_id = head AND place <= h
      UNION ALL
      SELECT c.conv_id, place, r, t FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
    steps AS (
      SELECT conv_id, row_number() OVER w AS depth, length(t) AS chars,
        string_agg(md5(length(r) || ':' || r || ':' || t), '/') OVER w AS path FROM taken
      WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
    members AS (
      SELECT conv_id, depth, chars, path FROM steps
      UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
    lengths AS (SELECT conv_id, max(depth) AS whole FROM members GROUP BY 1),
    nodes AS (
      SELECT path, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id,
        count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ','
          ORDER BY conv_id) FILTER (WHERE depth = whole), '')) AS ends_sha256
      FROM members JOIN lengths USING (conv_id) GROUP BY path),
    up AS (
      SELECT n.path, n.depth, n.chars, n.n_convs, m.path AS above, m.depth AS above_depth
      FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth),
    below AS (SELECT above AS path, count(*) AS n FROM up WHERE above_depth = depth - 1 GROUP BY 1),
    sums AS (
      SELECT above AS path, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens,
        count(*) FILTER (WHERE up.path NOT IN (SELECT path FROM below)) AS n_leaves
      FROM up GROUP BY 1)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
      coalesce(b.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums USING (path) LEFT JOIN below b USING (path)
      LEFT JOIN up u ON u.path = n.path AND u.above_depth = n.depth - 1
      LEFT JOIN nodes p ON p.path = u.above"""
