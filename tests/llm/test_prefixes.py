"""The prefix trie against a dictionary of all beginnings, and its search tree."""

import random
import zlib
from hashlib import sha256

import pytest

from likeness.llm import prefixes, queries

SF = "/root/testdata/sf0.01"


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(found)] for c, found in convs.items()}
    nodes, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = (*turns.get(c - c % 100, [])[:h], *own[h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    found = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(len(m) > len(n) and m[: len(n)] == n for m in under)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in under if n)
        told = ",".join(map(str, sorted(ends.get(node, []))))
        found.append(
            (
                min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                len(children), len(leaves), saved, sha256(told.encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_is_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert shown(queries.op13_prefix_trie(spark, SF)) == brute(map(tuple, rows.collect()))


@pytest.mark.parametrize("seed,shard_turns", [(1, 10), (2, 40), (3, 1), (4, 100_000)])
def test_shared_beginnings_over_many_ranges(spark, seed, shard_turns, monkeypatch):
    """Few different turns, so that nodes lie at the borders of ranges; many copies."""
    monkeypatch.setattr(prefixes, "ID_BITS", 3)
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(400), 120):
        n = pick.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t, pick.choice("ua"), pick.choice(["x", "yé", ""])) for t in range(n)]
    for c in range(1000, 1090):  # copies
        rows += [(c, t, "u", "same") for t in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = shown(prefixes.prefix_trie(df.repartition(5), shard_turns=shard_turns))
    assert got == brute(rows)


def test_edge_cases(spark):
    rows = [
        (1, None, "u", "first"), (1, 0, "u", None), (1, 0, "u", None), (1, 0, None, "tie"),
        (None, 0, "u", "no id"), (101, 3, "u", "x"), (-7, 0, "u", "x"), (-100, 0, "", "😀 é"),
        (200, 0, "a:b", "c"), (300, 0, "a", "b:c"), (5, 1, "u", "long " * 50_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS AT", "2 AS seq", "'x' AS Digest")
    got = shown(prefixes.prefix_trie(df, shard_turns=2))
    # Spark's remainder keeps the sign of a negative id; Python's does not.
    want = [r for r in rows if r[0] is None or r[0] >= 0]
    assert shown(prefixes.prefix_trie(df.filter("conv_id IS NULL OR conv_id >= 0"))) == brute(want)
    assert [r[3] for r in got if r[1] == 0] == [7]
    assert prefixes.prefix_trie(df.limit(0)).collect() == []


def test_long_conversations_need_no_recursion(spark):
    rows = [(c, t, "u", str(t % 7)) for c in (0, 1, 2) for t in range(3000)]
    rows += [(2, 3000, "u", "more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefixes.prefix_trie(df)
    assert got.count() == 3002
    assert [tuple(r)[:6] for r in got.filter("depth >= 3000").orderBy("depth").collect()] == [
        (0, 3000, 0, 3, 1, 1), (2, 3001, 0, 1, 0, 1),
    ]


def test_the_tree_is_balanced_and_lists_parents_first():
    n = 1000
    tree = prefixes.Ternary()
    assert sorted(prefixes.median_first(n)) == list(range(n))
    for at in prefixes.median_first(n):
        tree.insert([at, 5], [1, 1], at)
    deepest, stack = 0, [(tree.below[0], 1)]
    while stack:
        node, deep = stack.pop()
        deepest = max(deepest, deep)
        stack += [(s, deep + 1) for s in (tree.low[node], tree.high[node]) if s >= 0]
    assert deepest == 10
    order, parent, depth = tree.listed()
    place = {node: at for at, node in enumerate(order)}
    assert len(order) == 2 * n + 1 and max(depth) == 2
    assert all(place[parent[node]] < place[node] for node in order[1:])
