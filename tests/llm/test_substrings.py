"""Substring dedup against brute force, the FM-index, and edge cases."""

import random

import brute
import numpy as np
import pytest

from likeness.llm import queries, substrings

SF = "/root/testdata/sf0.01"


def test_dedup_is_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op9_substring_dedup(spark, SF).collect()))
    want = sorted(brute.substring_rows(docs))
    assert got == want and sum(w[2] for w in want) > 1000


def passages(seed):
    """Documents made of shared passages, repeats of few words, edits and unique words."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    shared = [pick.choices(words, k=pick.randrange(5, 60)) for _ in range(6)]
    texts = []
    for d in range(120):
        text = []
        for _ in range(pick.randrange(0, 6)):
            if pick.random() < 0.6:
                part = list(pick.choice(shared))
                if pick.random() < 0.3 and part:
                    part[pick.randrange(len(part))] = f"e{d}"
                text += part
            else:
                text += pick.choices(words, k=pick.randrange(40)) + [f"u{d}"] * pick.randrange(30)
        texts.append(pick.choice([" ", "\n", " \t"]).join(text))
    return texts


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"hot_segments": 2}), (3, {"shard_segments": 5}), (4, {"window": 6, "group": 2})])
def test_passages(spark, seed, how):
    texts = passages(seed)
    rows = [(3 * i - 50, t, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, texts[7], "x", None), (1000, None, None, None), (1001, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, Whose string")
    got = sorted(map(tuple, substrings.digests(docs, **how).collect()), key=repr)
    want = brute.substring_rows([r[:2] for r in rows], how.get("window", 20))
    assert got == sorted(want, key=repr)
    if not how:
        kept = substrings.without_repeats(docs)
        assert kept.columns == docs.columns
        by = {r.doc_id: r.text for r in kept.collect()}
        for doc_id, _, removed, digest in want:
            if removed:
                assert brute.sha(by[doc_id]) == digest
        assert by[1000] is None and by[1001] == ""


def test_repeats_inside_one_long_text(spark):
    text = " ".join(["a"] * 70 + [f"w{i % 900}" for i in range(5000)])
    docs = spark.createDataFrame([(1, text), (2, "b " * 19), (3, "b " * 20)], "doc_id long, text string")
    got = sorted(map(tuple, substrings.digests(docs).collect()))
    assert got == sorted(brute.substring_rows(map(tuple, docs.collect())))


def test_rows_of_one_id_do_not_remove_each_other(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(5, text), (5, text), (6, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substrings.digests(docs).collect())
    assert got == [(5, 0), (5, 0), (6, 40)]
    assert substrings.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_backward_search_counts_occurrences(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, 6, 300)
    index = substrings.FMIndex(codes, 8)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        at = int(rng.integers(0, 300 - n))
        pattern = codes[at : at + n] if rng.random() < 0.7 else rng.integers(1, 6, n)
        low, high = np.array([0]), np.array([len(codes) + 1])
        for c in reversed(pattern.tolist()):
            low, high = index.extend(np.array([c]), low, high)
        want = [i for i in range(300 - n + 1) if (codes[i : i + n] == pattern).all()]
        assert sorted(index.suffixes[low[0] : high[0]].tolist()) == want


def test_wavelet_rank():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 37, 1000)
    tree = substrings.WaveletTree(codes, 6)
    ends, asked = rng.integers(0, 1001, 200), rng.integers(0, 37, 200)
    want = [(codes[:e] == c).sum() for e, c in zip(ends, asked)]
    assert tree.rank(asked, ends).tolist() == want


@pytest.mark.parametrize("how", [{}, {"hot_segments": 1}])
def test_rows_of_one_id_keep_their_own_words(spark, how):
    """A passage is cut where it stands in a row, not at its places in other rows of the id."""
    passage = [f"p{i}" for i in range(40)]
    other = [f"x{i}" for i in range(160)]
    long = " ".join(other[:100] + passage + other[100:])
    edited = " ".join([*passage[:25], "new", *passage[26:]])
    for doc_id in (None, 7):
        rows = [(doc_id, " ".join(passage)), (doc_id, long), (doc_id, edited), (9, "z " * 10)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = substrings.without_repeats(docs, **how).collect()
        kept = [w for r in got for w in r.text.split()]
        # Nothing is lost: all words of all rows are still there, the passage's own ones too.
        assert {*passage, *other, "new"} <= set(kept)
        assert sum(w in set(other) for w in kept) == len(other)
        # The first 25 words of the passage, which all three have, are left once.
        assert [kept.count(w) for w in passage[:25]] == [1] * 25
