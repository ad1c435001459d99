"""SimHash groups against all pairs, the trees, and components."""

import random

import brute
import numpy as np
import pytest

from likeness.llm import queries, simhash
from likeness.llm.components import connected

SF = "/root/testdata/sf0.01"


def test_groups_are_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5_simhash_groups(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute.simhash_rows(docs)
    assert len({r.component_id for r in got}) < len(docs)


def near_prints(seed, n):
    """Random fingerprints, chains of flips, and a tight cluster."""
    pick = random.Random(seed)
    values = [pick.getrandbits(64) for _ in range(n)]
    chain = values[0]
    for _ in range(n // 4):
        for b in pick.sample(range(64), 4):
            chain ^= 1 << b
        values.append(chain)
    values += [values[1] ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)]
    return sorted(set(values))


@pytest.mark.parametrize("seed,spaces", [(1, 3), (2, 1), (3, 5), (4, 2)])
def test_links_connect_what_all_pairs_connect(spark, seed, spaces, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    values = near_prints(seed, 500)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fingerprint long, node long")
    got = simhash.links(prints, spaces=spaces, shard_rows=100)
    edges = [tuple(r) for r in got.collect()]
    assert all(a != b for a, b in edges)
    groups = simhash.Groups(len(values))
    if edges:
        groups.join(*map(np.array, zip(*edges)))
    want = brute.components(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    pairs = set(zip(groups.label.tolist(), want.values()))
    assert len(pairs) == len(set(want.values())) == len(set(groups.label.tolist()))


def test_a_tree_sends_balls_wherever_they_reach():
    pick = random.Random(5)
    values = np.array([pick.getrandbits(64) for _ in range(2000)], np.uint64)
    mask = simhash.masks()[1]
    tree = simhash.Tree(values[:500], mask, 1, 16)
    rows, leaf, own = tree.shards(values)
    home = dict(zip(rows[own].tolist(), leaf[own].tolist()))
    assert len(home) == own.sum() == len(values) and tree.leaves == 16
    reached = set(zip(rows.tolist(), leaf.tolist()))
    near = np.bitwise_count((values[:, None] ^ values[None, :]) & np.uint64(mask)) <= 1
    for a, b in zip(*np.nonzero(np.triu(near, 1))):
        a, b = sorted((int(a), int(b)), key=lambda n: home[n])
        assert (a, home[b]) in reached


def test_edge_cases(spark):
    rows = [
        (5, "The same words are HERE", "x"),
        (3, "the same words are here", "x"),
        (3, "the same words are here", "x"),
        (4, None, None),
        (2, "", None),
        (9, " \t\n", None),
        (None, "the same words are here", None),
        (7, "one", "x"),
        (8, "é É ü", "x"),
        (8, "one", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Node string")
    got = sorted(map(tuple, simhash.with_groups(docs).collect()), key=repr)
    empty = "0" * 16
    assert [(d, c) for d, f, c in got if f == empty] == [(2, 2), (4, 2), (9, 2)]
    assert {c for d, _, c in got if d in (3, 5)} == {3}
    assert [c for d, _, c in got if d is None] == [None]
    assert {c for d, _, c in got if d in (7, 8)} == {7}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 3, 7, None]
    assert simhash.with_groups(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (2000, 2001), (2001, 2000)], "a long, b long")
    got = dict(map(tuple, connected(df).collect()))
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000}
    assert got[2001] == 2000 and len(got) == 201 + 300 + 2


@pytest.mark.parametrize("text", [None, "", "a", "a b c", "a b c d", "A é É b " * 50, "w " * 40_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) % 2**64 == brute.fingerprint(text)


def test_one_of_each_group_stays(spark):
    """Copies with one changed word in 2,000, and texts that share but a half."""
    pick = random.Random(8)
    parts = "an er th on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar".split()

    def words(n):
        return ["".join(pick.choices(parts, k=pick.randrange(1, 5))) for _ in range(n)]

    rows, clean = [], set()
    for g in range(30):
        base = words(2000)
        rows.append((100 * g, " ".join(base)))
        clean.add(100 * g)
        for k in range(1, 6):
            edited = list(base)
            edited[pick.randrange(2000)] = f"new{g}x{k}"
            rows.append((100 * g + k, " ".join(edited)))
        rows.append((100 * g + 50, " ".join(base[:1000] + words(1000))))
        clean.add(100 * g + 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert clean <= kept and len(kept) < len(clean) + 60
    assert kept == {d for d, _, c in brute.simhash_rows(rows) if d == c}
