"""Toxicity of whole texts, read through the spellings that hide it.

A noisy channel: what was meant went through letters written as digits and signs, letters set
apart, and letters repeated. Each suspicious word is a lattice of what its characters may stand
for, and the Viterbi path under a character language model is what was meant. The model's counts
of one, two and three characters are taken over all texts; they lie in tables of a fixed size, by
hash, so that every task can hold them. Plain words are their own only path and are not decoded.

Restored words and their beginnings have log-odds of being said in toxic texts, learnt from
labelled rows. How many of a text's words have high odds, how high they are and how large their
share is, is weighed by a logistic regression. That is fitted on odds that were learnt from the
other half of the labelled rows each time, so a row's own words do not speak for its label.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from likeness.llm.common import key
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Labelled rows that are learnt from: all if fewer, else those of the smallest hash.
MOST_LABELLED = 20_000
FOLDS = 5
# What a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
# Costs of the channel, in nats: a letter written as a sign, a letter said again, a mark or
# blank between the letters of a word, and a word that ends within what is written as one.
SIGN, AGAIN, APART, EDGE = 1.0, 0.3, 0.3, 5.0
# Slots of the counts of one, two and three characters; weight of the shorter context; letters
# among which an unseen one is any.
ORDERS = (1 << 16, 1 << 18, 1 << 20)
BACK, LETTERS = 2.0, 64
# Characters that are counted at once.
AT_ONCE = 1 << 21
# Paths that are followed at once, characters of words that are remembered, and words.
PATHS, LONGEST, REMEMBERED = 24, 40, 400_000
# Slots of the odds of words; what each count is raised by; times that a word counts in a text.
SLOTS = 1 << 20
ALPHA, MOST_TIMES = 0.5, 99
PREFIXES, MARK = (4, 5, 6), zlib.crc32(b"^")
LEVELS = (1.0, 2.0, 3.0)
RIDGE = 1.0
MEASURES = 2 + 2 * len(LEVELS) + 3

SPELT = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
LETTER = re.compile(r"[^\W\d_]")
THRICE = re.compile(r"(.)\1\1")
EDGES = "".join(c for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…«»“”„’" if c not in SIGNS)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def slot(codes, order: int):
    """The slot of ``order`` + 1 characters; of whole numbers or of arrays of them alike."""
    total = 0
    for factor, code in zip(FACTORS, codes, strict=False):
        total = total + code * (np.uint64(factor) if isinstance(code, np.ndarray) else factor)
    bits = ORDERS[order].bit_length() - 1
    if isinstance(total, np.ndarray):
        return (total >> np.uint64(64 - bits)).astype(np.int64)
    return (total & (2**64 - 1)) >> (64 - bits)


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter and else 0."""
    points = np.zeros(0x110000, np.uint32)
    kept = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    points[kept] = kept
    return points


def character_counts(texts, points: np.ndarray, counts: list[np.ndarray]) -> None:
    """Adds the characters of whole texts to ``counts``; whatever is no letter is a blank, and
    between words there are always two, so that no word depends on the one before."""
    raw = "\n".join(text.lower() for text in texts if text).encode("utf-32-le", "surrogatepass")
    found = points[np.frombuffer(raw, np.uint32)]
    found = np.concatenate([[0], found, [0]]).astype(np.uint64)
    found = found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])]
    found = np.repeat(found, np.where(found == 0, 2, 1))
    for order in range(3):
        codes = [found[2 - back : len(found) - back] for back in range(order + 1)]
        counts[order] += np.bincount(slot(codes, order), minlength=ORDERS[order])


def language_model(docs: DataFrame, text: str) -> list[np.ndarray]:
    """Counts of all texts' characters by slot. A task sends the slots it has met."""
    target = to_arrow_schema(T._parse_datatype_string("part int, slot int, n long"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, counts = letters(), [np.zeros(n, np.int64) for n in ORDERS]
        for batch in batches:
            texts, size = [], 0
            for text in batch.column(0).to_pylist():
                texts.append(text)
                size += len(text or "")
                if size >= AT_ONCE:
                    character_counts(texts, points, counts)
                    texts, size = [], 0
            character_counts(texts, points, counts)
        for part, found in enumerate(counts):
            at = np.flatnonzero(found)
            columns = [np.full(len(at), part, np.int32), at.astype(np.int32), found[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=target)

    body = docs.select(F.col(key(text)).cast("string").alias("text"))
    tables = body.mapInArrow(counted, "part int, slot int, n long")
    summed = tables.groupBy("part", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = [np.zeros(n, np.int64) for n in ORDERS]
    parts, slots, found = (summed.column(c).to_numpy() for c in ("part", "slot", "n"))
    for part in range(3):
        counts[part][slots[parts == part]] = found[parts == part]
    return counts


def readings(shown: str, at: int) -> list[tuple[str, float]]:
    """(letter, cost): what the character may stand for; a blank ends a word, and nothing at all
    is left of a letter said three times or more, or of a mark between letters that stand alone."""
    c, end = shown[at], len(shown) - 1
    if c.isalpha():
        options = [(c, 0.0)]
    elif c in SIGNS:
        options = [(" ", EDGE if at < end else 0.0), *((s, SIGN) for s in SIGNS[c])]
    else:
        options = [(" ", 0.0)]
        single = at < 2 or not (shown[at - 2].isalpha() or shown[at - 2] in SIGNS)
        single &= at > end - 2 or not (shown[at + 2].isalpha() or shown[at + 2] in SIGNS)
        if 0 < at < end and single:
            options = [(" ", EDGE), ("", APART)]
    if c == shown[at - 1 : at] and not c.isspace():
        if c in (shown[at - 2 : at - 1], shown[at + 1 : at + 2]):  # two alike are common in words
            options.append(("", AGAIN))
        if c in SIGNS:  # a run of signs is one edge
            options[0] = (" ", 0.0)
    return options


class Reader:
    """Restores words; remembers those that it has decoded."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = counts
        self.total = int(counts[0].sum())
        self.known: dict[str, tuple[str, ...]] = {}
        self.costs: dict[tuple[str, str, str], float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """-log P(c | a, b); a blank stands for the edge of a word."""
        found = self.costs.get((a, b, c))
        if found is None:
            x, y, z = (0 if s == " " else ord(s) for s in (a, b, c))
            one, two, three = self.counts
            p = (int(one[slot((z,), 0)]) + 1 / LETTERS) / (self.total + 1)
            p = (int(two[slot((z, y), 1)]) + BACK * p) / (int(one[slot((y,), 0)]) + BACK)
            p = (int(three[slot((z, y, x), 2)]) + BACK * p) / (int(two[slot((y, x), 1)]) + BACK)
            if len(self.costs) >= REMEMBERED:
                self.costs.clear()
            found = self.costs[a, b, c] = -math.log(min(max(p, 1e-12), 1.0))
        return found

    def decode(self, shown: str) -> str:
        """The likeliest meant letters, words apart by blanks."""
        paths = {(" ", " "): (0.0, None)}  # the last two letters: cost, (letter, path before)
        for at in range(len(shown)):
            options = readings(shown, at)
            ahead: dict = {}
            for (a, b), (cost, way) in paths.items():
                for meant, extra in options:
                    if not meant or (meant == " " and b == " "):
                        state, total, longer = (a, b), cost + extra, way
                    else:
                        state = (b, meant) if meant != " " else (" ", " ")
                        total = cost + extra + self.cost(a, b, meant)
                        longer = (meant, way)
                    if state not in ahead or total < ahead[state][0]:
                        ahead[state] = (total, longer)
            if len(ahead) > PATHS:
                ahead = dict(sorted(ahead.items(), key=lambda p: p[1][0])[:PATHS])
            paths = ahead
        ends = ((cost + (0.0 if b == " " else self.cost(a, b, " ")), way) for (a, b), (cost, way) in paths.items())
        _, way = min(ends, key=lambda end: end[0])
        meant = []
        while way is not None:
            meant.append(way[0])
            way = way[1]
        return "".join(reversed(meant))

    def words(self, token: str) -> tuple[str, ...]:
        """The words that a token of lower-case characters without blanks stands for."""
        if token.isalpha() and not THRICE.search(token):
            return (token,)
        found = self.known.get(token)
        if found is None:
            core = token.strip(EDGES)
            if core.isalpha() and not THRICE.search(core):
                found = (core,)
            else:  # a number or signs alone are no word
                found = tuple(self.decode(core).split()) if LETTER.search(core) else ()
            if len(token) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[token] = found
        return found

    def parts(self, text: str | None) -> tuple[list[str], list[str]]:
        """(tokens, spelt): the whole text's tokens, and the words that were spelt letter by
        letter, read."""
        text, found = (text or "").lower(), []
        spelt = SPELT.findall(text)
        if spelt:
            text = SPELT.sub(" ", text)
            for run in spelt:
                found += self.decode(run).split()
        return text.split(), found

    def bag(self, text: str | None) -> Counter:
        """How often the whole text has each restored word."""
        tokens, spelt = self.parts(text)
        bag = Counter(spelt)
        for token, n in Counter(tokens).items():
            for word in self.words(token):
                bag[word] += n
        return bag


def features(word: str) -> list[int]:
    """Slots of the word and of its beginnings, which are marked."""
    raw = word.encode("utf-8", "surrogatepass")
    found = [zlib.crc32(raw) % SLOTS]
    narrow = len(raw) == len(word)
    for n in PREFIXES:
        if len(word) <= n:
            break
        start = raw[:n] if narrow else word[:n].encode("utf-8", "surrogatepass")
        found.append(zlib.crc32(start, MARK) % SLOTS)
    return found


def telling(word: str, odds) -> float:
    """The odds of a word's most telling feature."""
    best = 0.0
    for at in features(word):
        value = odds[at]
        if abs(value) > abs(best):
            best = value
    return best


class Odds(dict):
    """The odds of tokens that are one plain word; not-a-number for all others, whose words'
    odds and number of hidden ones are in ``others``. Filled as tokens come, and bounded."""

    def __init__(self, reader: Reader, odds: np.ndarray):
        self.reader, self.odds = reader, array("d", odds.astype(float).tobytes())
        self.others: dict[str, tuple[list[float], int]] = {}

    def __missing__(self, token: str) -> float:
        words = self.reader.words(token)
        plain = len(words) == 1 and words[0] in token
        value = telling(words[0], self.odds) if plain else math.nan
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = value
        return value

    def other(self, token: str) -> tuple[list[float], int]:
        found = self.others.get(token)
        if found is None:
            words = self.reader.words(token)
            found = [telling(w, self.odds) for w in words], sum(w not in token for w in words)
            if len(token) <= LONGEST:
                if len(self.others) >= REMEMBERED:
                    self.others.clear()
                self.others[token] = found
        return found

    def of_text(self, text: str | None) -> tuple[np.ndarray, int]:
        """The odds of each word of the whole text, in any order, and how many were hidden."""
        rest, spelt = self.reader.parts(text)
        values = np.fromiter(map(self.__getitem__, rest), float, len(rest))
        more, hidden = [telling(w, self.odds) for w in spelt], sum(len(w) > 1 for w in spelt)
        odd = np.isnan(values)
        if odd.any():
            for at in np.flatnonzero(odd).tolist():
                found, n = self.other(rest[at])
                more += found
                hidden += n
            values = values[~odd]
        return np.concatenate([values, more]), hidden


def measures(values: np.ndarray) -> list[float]:
    """What the regression weighs, from the odds of a text's words."""
    size = max(1, len(values))
    hits = [int((values > level).sum()) for level in LEVELS]
    most = np.partition(values, len(values) - 5)[-5:] if len(values) > 5 else values
    return [
        1.0,
        math.log(size),
        *(math.log1p(h) for h in hits),
        *(100 * h / size for h in hits),
        10 * float(values.sum()) / size,
        float(np.sort(most).mean()) if len(most) else 0.0,
        float(most.max()) if len(most) else 0.0,
    ]


def learnt_odds(toxic: np.ndarray, clean: np.ndarray, words: tuple[int, int]) -> np.ndarray:
    share = max(1, words[1]) / max(1, words[0])
    return np.log((toxic + ALPHA) / (clean / share + ALPHA)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """``weights`` of standardised measures; without both kinds of labels just ``share``."""

    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    share: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(rows):
            return np.full(len(rows), self.share)
        z = np.clip(((rows - self.mean) / self.scale) @ self.weights, -500, 500)
        return 1 / (1 + np.exp(-z))


def regression(rows: np.ndarray, toxic: np.ndarray, odds: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's method, the first measure being constant."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    mean, scale = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    if not 0 < share < 1:
        return Model(odds, mean, scale, None, share)
    z = (rows - mean) / scale
    ridge = np.full(z.shape[1], RIDGE)
    ridge[0] = 1e-6
    weights = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -500, 500)))
        slope = z.T @ (toxic - p) - ridge * weights
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(odds, mean, scale, weights, share)


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_bags(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, counts: list, most: int
) -> DataFrame:
    """(toxic, half, words, times) of at most ``most`` labelled rows, stored."""
    told = labels.select(
        F.col(key(id)).cast("long").alias("told"), F.col(key(label)).cast("int").alias("toxic")
    ).filter(F.col("told").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("told")))
    told = told.groupBy("told").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    told = cut(told.orderBy(F.xxhash64("told"), "told").limit(most))  # MOST_LABELLED small rows
    body = docs.select(F.col(key(id)).cast("long").alias("id"), F.col(key(text)).cast("string").alias("text"))
    ready = body.join(F.broadcast(told), F.col("id") == F.col("told"))
    schema = "toxic int, half int, words array<string>, times array<int>"
    target = to_arrow_schema(T._parse_datatype_string(schema))
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            bags = [reader.bag(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("toxic"), batch.column("half"),
                pa.array([list(b) for b in bags], target.field("words").type),
                pa.array([list(b.values()) for b in bags], target.field("times").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    half = (F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))).cast("int").alias("half")
    return cut(ready.select("toxic", half, "text").mapInArrow(restored, schema))


def fitted(bags: DataFrame) -> Model:
    """Odds of both halves and of all rows, and the regression on what each half's rows measure
    by the other half's odds."""
    schema = "kind int, slot int, n long"
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, SLOTS + 1), np.int64)  # the last slot has the number of words
        for batch in batches:
            kinds = 2 * np.asarray(batch.column("half")) + np.asarray(batch.column("toxic"))
            words, times = batch.column("words").to_pylist(), batch.column("times").to_pylist()
            for kind, some, often in zip(kinds.tolist(), words, times, strict=True):
                for word, n in zip(some, often, strict=True):
                    counts[kind, features(word)] += min(n, MOST_TIMES)
                counts[kind, SLOTS] += sum(often)
        kind, at = np.nonzero(counts)
        columns = [kind.astype(np.int32), at.astype(np.int32), counts[kind, at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=target)

    summed = bags.mapInArrow(counted, schema).groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((4, SLOTS + 1), np.int64)
    counts[summed.column("kind").to_numpy(), summed.column("slot").to_numpy()] = summed.column("n").to_numpy()

    def odds(rows):
        clean, toxic = counts[rows[0]].sum(axis=0), counts[rows[1]].sum(axis=0)
        return learnt_odds(toxic[:-1], clean[:-1], (int(toxic[-1]), int(clean[-1])))

    by_half = bags.sparkSession.sparkContext.broadcast([odds(([0], [1])), odds(([2], [3]))])
    told = "toxic int, row array<double>"
    shape = to_arrow_schema(T._parse_datatype_string(told))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [array("d", odds.astype(float).tobytes()) for odds in by_half.value]
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("half", "words", "times"))
            for half, words, times in zip(*columns, strict=True):
                odds = tables[1 - half]
                values = np.array([telling(word, odds) for word in words], float)
                rows.append(measures(np.repeat(values, times)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, shape.field("row").type)], schema=shape)

    # MOST_LABELLED rows of MEASURES numbers at most.
    rows = sorted(bags.mapInArrow(measured, told).collect())
    matrix = np.array([r.row for r in rows]).reshape(-1, MEASURES)
    if not len(rows):
        matrix = np.zeros((1, MEASURES))
    return regression(matrix, np.array([r.toxic for r in rows], float), odds(([0, 2], [1, 3])))


def with_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """(id, held_out, score, predicted, n_hidden) for every row; ``n_hidden`` counts words that
    were restored from another spelling.

    Only whole texts are scored: null and empty ones have no words and get the score of that.
    Labels are learnt from rows whose id is not held out, at most ``most_labelled`` of them; an
    id with several labels is toxic if one of them says so. Rows without id or label teach
    nothing; rows without id are scored and not held out. Repeated rows get equal scores. If
    the labels are all of one kind the score is 0 or 1 for all, and 0 without labels. Without
    documents there are no rows. Other columns are left out.
    """
    counts = language_model(docs, text)
    model = fitted(training_bags(docs, labels, id, text, label, counts, most_labelled))
    held = docs.sparkSession.sparkContext.broadcast((counts, model))

    schema = T.StructType(
        [
            T.StructField(id, docs.schema[id].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("n_hidden", T.LongType()),
        ]
    )
    target = to_arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, model = held.value
        odds = Odds(Reader(counts), model.odds)
        for batch in batches:
            rows, hidden = [], []
            for body in batch.column(2).to_pylist():
                values, n = odds.of_text(body)
                rows.append(measures(values))
                hidden.append(n)
            score = model.score(np.array(rows).reshape(-1, MEASURES))
            columns = [
                batch.column(0), batch.column(1), pa.array(score),
                pa.array((score >= 0.5).astype(np.int32)), pa.array(hidden, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    own = F.col(key(id))
    ready = docs.select(own, held_out(own).alias("held"), F.col(key(text)).cast("string").alias("body"))
    return ready.mapInArrow(scored, schema)
