"""Restored spellings against brute force, and held-out accuracy."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from likeness.llm import queries, toxicity

SF = "/root/testdata/sf0.01"
INSULTS = "idiot moron loser scum worthless trash stupid pathetic clown disgusting".split()


@pytest.fixture(scope="module")
def counts(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet").repartition(3), "text")


def test_counts_are_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = toxicity.language_model(docs.repartition(3), "text")
    want = [np.zeros(n, np.int64) for n in toxicity.ORDERS]
    for (text,) in docs.select("text").collect():
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        codes = [0, 0, *(code for word in words for code in (*map(ord, word), 0, 0))]
        for at in range(2, len(codes)):
            for order in range(3):
                mine = [codes[at - back] for back in range(order + 1)]
                want[order][toxicity.slot(mine, order)] += 1
    assert all((a == b).all() for a, b in zip(counts, want))


def spoken(reader, text):
    cost, a, b = 0.0, " ", " "
    for c in text + " ":
        if not (c == " " and b == " "):
            cost += reader.cost(a, b, c)
            a, b = (b, c) if c != " " else (" ", " ")
    return cost


@pytest.mark.parametrize("shown", ["1d10t", "sttt.uu", "a-b!!c", "l0$$er", "ab", "!", "x x 3", "i d i 0 t"])
def test_the_path_found_is_the_best_of_all(counts, shown):
    """Every reading of every character, one by one."""
    reader = toxicity.Reader(counts)
    prices = {}
    for way in itertools.product(*[toxicity.readings(shown, at) for at in range(len(shown))]):
        text = " ".join("".join(c for c, _ in way).split())
        prices[text] = min(sum(x for _, x in way), prices.get(text, math.inf))
    costs = {text: extra + spoken(reader, text) for text, extra in prices.items()}
    assert costs[" ".join(reader.decode(shown).split())] == pytest.approx(min(costs.values()))


@pytest.mark.parametrize(
    "shown,at,want",
    [
        ("h3y", 1, {" ": toxicity.EDGE, "e": toxicity.SIGN}), ("hey!", 3, {" ": 0, "i": 1, "l": 1}),
        ("a.b", 1, {" ": toxicity.EDGE, "": toxicity.APART}), ("ab.cd", 2, {" ": 0}),
        ("see", 2, {"e": 0}), ("seee", 2, {"e": 0, "": toxicity.AGAIN}), ("x", 0, {"x": 0}),
    ],
)
def test_readings(shown, at, want):
    assert dict(toxicity.readings(shown, at)) == want


def test_hidden_insults_are_read(counts):
    reader = toxicity.Reader(counts)
    disguises = {"a": "@4", "e": "3", "i": "1!", "o": "0", "s": "$5", "t": "7+"}
    pick, right, tried = random.Random(1), 0, 0
    for word in INSULTS:
        for _ in range(4):
            at = pick.choice([i for i, c in enumerate(word) if c in disguises or c == "c"])
            sign = pick.choice(disguises.get(word[at], "("))
            shown = word[:at] + sign + word[at + 1 :]
            long = word[:at] + word[at] * pick.randrange(3, 7) + word[at + 1 :]
            right += (reader.words(shown) == (word,)) + (reader.words(long) == (word,))
            tried += 2
        right += reader.bag(f"the {' '.join(word)} of")[word]
        tried += 1
    assert right / tried >= 0.85
    for plain in ("226.203.165.104", "2.0.", "$$$", "***"):
        assert reader.words(plain) == () or not set(reader.words(plain)) & set(INSULTS)
    assert reader.words("than***") == ("than",) and reader.words("(été),") == ("été",)


def test_odds_of_a_text_are_those_of_its_restored_words(spark, counts):
    reader = toxicity.Reader(counts)
    odds = np.random.default_rng(1).normal(size=toxicity.SLOTS).astype(np.float32)
    found = toxicity.Odds(toxicity.Reader(counts), odds)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    for text in [*(r.text for r in docs), None, "", "an i d i o t, l0$er! 12 x.y ... the the", "a" * 99]:
        values, hidden = found.of_text(text)
        want = [toxicity.telling(w, odds) for w, n in reader.bag(text).items() for _ in range(n)]
        assert sorted(values.tolist()) == sorted(want) and hidden >= 0
    assert found.of_text("an i d i o t, l0ser the")[1] == 2


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    assert len(got) == 10_000
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    kept = [(got[d].predicted, t) for d, t in labels.items() if got[d].held_out]
    said, true = sum(p for p, _ in kept), sum(t for _, t in kept)
    both = sum(p and t for p, t in kept)
    assert both / said >= 0.93 and both / true >= 0.9


def test_disguised_texts_are_toxic_and_clean_ones_are_not(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 4000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.filter("lang = 'en'").join(labels.filter("quality = 1 AND toxic = 0"), "doc_id")
    clean = [r.text for r in some.orderBy("doc_id").limit(40).collect()]
    docs = docs.select("doc_id", "text")
    pick, rows = random.Random(4), []
    table = str.maketrans({"o": "0", "i": "1", "s": "$", "a": "@"})
    for at, text in enumerate(clean):
        words = text.split()
        for _ in range(max(3, len(words) // 30)):
            word = pick.choice(INSULTS)
            shown = pick.choice([word.translate(table), " ".join(word), word.replace("o", "oooo")])
            words.insert(pick.randrange(len(words)), shown)
        rows += [(10_000_000 + at, text), (20_000_000 + at, " ".join(words))]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.with_toxicity(docs.union(more), labels).filter("doc_id >= 10000000").collect()
    bad = [r for r in got if r.doc_id >= 20_000_000]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in got if r.doc_id < 20_000_000) <= 0.05 * len(bad)
    assert sum(r.n_hidden > 0 for r in bad) >= 0.9 * len(bad)


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "you idiot", 3), (3, "x " * 60_000, 4), (3, "x", 5), (4, "a\ud800b".encode("utf-8", "replace").decode(), 6), (5, "9" * 3000 + " i d i o t " * 500, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        got = toxicity.with_toxicity(docs, some).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in toxicity.with_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.with_toxicity(docs.limit(0), labels).collect() == []
