"""Substring dedup: passages of at least ``WINDOW`` words that occurred earlier are removed.

Equal windows have the same anchor: the smallest hash among the word groups inside them.
So the consecutive windows of one anchor make a segment, segments are dealt out by anchor,
and whatever is equal meets. An anchor that occurs once has nothing to match, and of equal
segments only the earliest goes on; both are settled by grouped counts and minima before
any text is moved. What is left, different segments around one anchor, goes to shards.
Each shard builds an FM-index of its segments, with a wavelet tree over the
Burrows-Wheeler transform, streams its segments through backward search, and reports the
windows whose matching statistics reach the threshold at an earlier place. An anchor with
very many different segments is split further, into single windows by their own hash.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import key, spare
from likeness.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 20
# Words of the groups among which a window's anchor is chosen.
GROUP = 6
# Different segments a shard should have, and those of one anchor beyond which the anchor
# is split into single windows.
SHARD_SEGMENTS = 4096
HOT_SEGMENTS = 16_384
SPANS = "array<struct<first:int,windows:int>>"


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15


def runs_hashed(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, a hash of every so many consecutive words, from those of the words:
    a polynomial, put together from runs of 1, 2, 4, ... words."""
    runs, n = {1: words}, 1
    while 2 * n <= max(sizes):
        runs[2 * n] = followed(runs[n], runs[n], n, n)
        n *= 2
    found = []
    for size in sizes:
        whole, length = None, 0
        for n in sorted(runs, reverse=True):
            if size & n:
                whole = runs[n] if whole is None else followed(whole, runs[n], length, n)
                length += n
        found.append(mixed(whole))
    return found


def followed(left: np.ndarray, right: np.ndarray, n: int, m: int) -> np.ndarray:
    """Hashes of runs of n words and the m words behind them."""
    count = len(left) - m if left is right else min(len(left), len(right) - n)
    return left[:count] * np.uint64(pow(BASE, m, 2**64)) + right[n : n + count]


def segments(words: list[bytes], window: int, group: int):
    """(anchor, content, first, count) arrays of a text's segments: hashes of the anchor and
    of the segment's words, its first window and its number of windows; and the windows'
    own hashes. None for a text without a window."""
    if len(words) < window:
        return None
    groups, own = runs_hashed(word_hashes(words), group, window)
    # The high half of a hash and its place: the least is the first of the smallest.
    least = (groups & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(groups), dtype=np.uint64)
    inside, n = window - group + 1, 1
    while 2 * n <= inside:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < inside:
        least = np.minimum(least[: n - inside], least[inside - n :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, len(own)])
    last = first + count - 1
    content = mixed(mixed(own[first] + count.astype(np.uint64)) ^ own[last])
    return groups[at[first]], content, first, count, own


def dealt(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(anchor, content, doc, row, first, windows) of every segment; ``anchor`` is the high half
    of the hash, enough to bring together what is equal."""

    def find(batches):
        for batch in batches:
            found, names, keys = [], [], []
            docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, row, text in zip(docs, rows, batch.column(2), strict=True):
                one = segments((text.as_py() or "").encode().split(), window, group)
                if one:
                    found.append(one[:4])
                    names += [doc] * len(one[0])
                    keys += [row] * len(one[0])
            if found:
                anchor, content, first, count = map(np.concatenate, zip(*found, strict=True))
                columns = [
                    pa.array((anchor >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(content.view(np.int64)),
                    pa.array(names, pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(first.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["anchor", "content", "doc", "row", "first", "windows"]
                )

    kinds = "anchor int, content long, doc long, row long, first int, windows int"
    return docs.mapInArrow(find, kinds)


class WaveletTree:
    """Rank over a sequence of codes: one packed bit row for each bit of the codes, the
    sequence being parted by that bit from row to row, with a count every 64 bits."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.n, self.rows = len(codes), []
        for b in reversed(range(bits)):
            bit = (codes >> b & 1).astype(bool)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, "u1")
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)]
            zeros = self.n - int(before[-1])
            self.rows.append((b, packed, before, zeros))
            codes = np.r_[codes[~bit], codes[bit]]

    def rank(self, code: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each code occurs before each end."""
        start = np.zeros_like(end)
        for b, packed, before, zeros in self.rows:
            one = (code >> b & 1).astype(bool)

            def ones(at):
                word = at >> 6
                kept = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
                return before[word] + np.bitwise_count(kept)

            x, y = ones(start), ones(end)
            start = np.where(one, zeros + x, start - x)
            end = np.where(one, zeros + y, end - y)
        return end - start


class FMIndex:
    """Backward search over a sequence of codes from 1 on; 0 ends the sequence."""

    def __init__(self, codes: np.ndarray, depth: int):
        """Suffixes are sorted by their first ``depth`` codes or more."""
        codes = np.r_[codes, 0]
        n, rank, width = len(codes), codes.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            pair = rank * (n + int(codes.max()) + 2) + after
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, pair[order][1:] != pair[order][:-1]])
            width *= 2
        self.suffixes = order
        counts = np.bincount(codes)
        self.smaller = np.r_[0, np.cumsum(counts)]
        self.tree = WaveletTree(codes[order - 1], max(1, int(codes.max()).bit_length()))

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Suffix ranges of ``code`` followed by what the ranges stand for."""
        base = self.smaller[code]
        return base + self.tree.rank(code, low), base + self.tree.rank(code, high)


def repeated(doc: np.ndarray, first: np.ndarray, texts: list[str], window: int) -> list[np.ndarray]:
    """For each segment, whether each of its windows occurs earlier, at a smaller (doc,
    start), in these segments."""
    order = np.lexsort((first, doc))
    parts = [texts[k].encode().split() for k in order]
    lengths = np.array([len(p) for p in parts])
    begins = np.cumsum(lengths + 1) - lengths - 1
    # Every segment ends in a code of its own, so no match runs from one into the next.
    kinds: dict[bytes, int] = {}
    codes = np.empty(int((lengths + 1).sum()), np.int64)
    for at, part in zip(begins, parts, strict=True):
        codes[at : at + len(part)] = [kinds.setdefault(w, len(kinds) + 1) for w in part]
    codes[begins + lengths] = len(kinds) + 1 + np.arange(len(parts))
    index = FMIndex(codes, window)
    counts = lengths - window + 1
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(begins, counts) + inside
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(codes) + 1)
    for k in reversed(range(window)):
        low, high = index.extend(codes[at + k], low, high)
    # The order of the windows as documents have them, and the least in each range.
    place = np.repeat(first[order], counts) + inside
    whose = np.repeat(doc[order], counts)
    turn = np.lexsort((place, whose))
    number = np.empty(len(turn), np.int64)
    new = (np.diff(whose[turn]) != 0) | (np.diff(place[turn]) != 0)
    number[turn] = np.r_[0, np.cumsum(new)]
    by_suffix = np.full(len(codes) + 1, len(codes) + 1)
    by_suffix[at] = number
    by_suffix = by_suffix[index.suffixes]
    lows, back = np.unique(low, return_inverse=True)
    highs = np.empty(len(lows), np.int64)
    highs[back] = high
    bounds = np.stack([lows, highs], axis=1).reshape(-1)
    least = np.minimum.reduceat(np.r_[by_suffix, len(codes) + 1], bounds)[::2]
    again = least[back] < number
    found = np.split(again, np.cumsum(counts)[:-1])
    result: list = [None] * len(texts)
    for k, one in zip(order, found, strict=True):
        result[k] = one
    return result


def row_key(text: Column) -> Column:
    """What tells rows of one id apart. Rows with one id and one text have the same passages
    in the same places, so they may share a key."""
    return F.xxhash64(text)


def spans_of(doc: int, row: int, first: int, again: np.ndarray) -> list[tuple[int, ...]]:
    """(doc, row, first, windows) of each run of repeated windows."""
    edges = np.flatnonzero(np.diff(np.r_[0, again.astype(np.int8), 0]))
    return [(doc, row, first + int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def repeats(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    group: int = GROUP,
    shard_segments: int = SHARD_SEGMENTS,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """(doc, row, spans): for each id and ``row_key`` with repeated windows, the runs of
    windows (first word, number of windows) whose words occur earlier: at a smaller id, in
    the same text at an earlier word, or in another text of the same id whose key is smaller.
    Null texts have no words; null is the smallest id; rows with one id and one text are not
    earlier than each other, but each is judged against the rest.
    """
    body = F.col(key(text))
    own = docs.select(
        F.col(key(id)).cast("long").alias("doc"), row_key(body).alias("row"), body.alias("text")
    )
    own_segments = dealt(own, window, group)
    shared = own_segments.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    # Written, so that the join below reads both sides from shuffles it can split.
    shared = cut(shared.select(F.col("anchor").alias("of")))
    # Segments of an anchor that occurs more than once.
    met = own_segments.join(shared, own_segments["anchor"] == shared["of"]).drop("of")
    met = cut(met)
    earliest = met.groupBy("anchor", "content").agg(
        F.min(F.struct("doc", "row", "first", "windows")).alias("best")
    )
    earliest = cut(earliest.select(F.col("anchor").alias("a"), F.col("content").alias("c"), "best"))
    is_it = F.col("doc").eqNullSafe(F.col("best.doc")) & (F.col("row") == F.col("best.row"))
    is_it = is_it & (F.col("first") == F.col("best.first"))
    later = met.join(earliest, (met["anchor"] == earliest["a"]) & (met["content"] == earliest["c"]))
    later = later.filter(~is_it).select("doc", "row", "first", "windows")
    # Anchors with different segments, whose windows may still be equal.
    kinds = earliest.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    kinds = cut(kinds.select(F.col("a").alias("of"), (F.col("n") > hot_segments).alias("hot")))
    shards = max(1, -(-kinds.agg(F.count("*")).first()[0] * 3 // shard_segments))
    asked = earliest.join(kinds, earliest["a"] == kinds["of"]).select(
        F.col("best.doc").alias("doc"),
        F.col("best.row").alias("key"),
        F.struct("best.first", "best.windows", "a", "hot").alias("segment"),
    )
    asked = asked.groupBy(F.col("doc").alias("whose"), "key")
    asked = asked.agg(F.collect_list("segment").alias("segments"))
    met_row = own["doc"].eqNullSafe(asked["whose"]) & (own["row"] == asked["key"])
    texts = own.join(asked, met_row)
    texts = texts.select("doc", "row", "text", "segments")

    def cut_out(batches):
        names = ["shard", "own", "doc", "row", "first", "text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for doc, row, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = (text or "").encode().split()
                hashed = None
                for one in wanted:
                    first, n = one["first"], one["windows"]
                    if one["hot"]:
                        if hashed is None:
                            (windows,) = runs_hashed(word_hashes(words), window)
                            hashed = windows.view(np.int64)
                        rows += [(None, int(hashed[k]), doc, row, k, None) for k in range(first, first + n)]
                    else:
                        part = b" ".join(words[first : first + n + window - 1]).decode()
                        rows.append((one["a"] % shards, None, doc, row, first, part))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    kinds = "shard long, own long, doc long, row long, first int, text string"
    pieces = cut(texts.mapInArrow(cut_out, kinds))

    # Null is the smallest id; inside the shards the smallest long stands for it, since
    # pandas would turn ids beside a null into floats.
    smallest = F.lit(-(2**63))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        doc, first = frame["doc"].to_numpy(np.int64), frame["first"].to_numpy(np.int64)
        row = frame["row"].to_numpy(np.int64)
        _, place = np.unique(np.stack([doc, row], axis=1), axis=0, return_inverse=True)
        again = repeated(place.reshape(-1), first, frame["text"].tolist(), window)
        found = []
        for d, r, f, a in zip(doc.tolist(), row.tolist(), first.tolist(), again, strict=True):
            found += spans_of(d, r, f, a)
        return pd.DataFrame(found, columns=["doc", "row", "first", "windows"])

    searched = pieces.filter("shard IS NOT NULL")
    searched = searched.select("shard", F.coalesce("doc", smallest).alias("doc"), "row", "first", "text")
    searched = searched.groupBy("shard").applyInPandas(search, "doc long, row long, first int, windows int")
    searched = searched.withColumn("doc", F.nullif("doc", smallest))
    single = pieces.filter("shard IS NULL").select("own", "doc", "row", "first")
    best = single.groupBy("own").agg(F.min(F.struct("doc", "row", "first")).alias("best"))
    best = cut(best.withColumnRenamed("own", "of"))
    split = single.join(best, single["own"] == best["of"]).filter(~is_it)
    split = split.select("doc", "row", "first", F.lit(1).alias("windows"))
    every = later.union(searched).union(split)
    return every.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))


def covered(n: int, spans, window: int) -> np.ndarray:
    """Which of n words lie in the windows of the spans."""
    marks = np.zeros(n + 1, np.int64)
    for span in spans if spans is not None else ():
        end = min(span["first"] + span["windows"] + window - 1, n)
        if span["first"] < end:
            marks[span["first"]] += 1
            marks[end] -= 1
    return np.cumsum(marks[:-1]) > 0


def kept_words(text: str | None, spans, window: int) -> tuple[int, list[bytes]]:
    words = (text or "").encode().split()
    if spans is None or not len(spans):
        return len(words), words
    gone = covered(len(words), spans, window)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def with_spans(docs: DataFrame, name: str, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with the repeated spans of each; null where there is none."""
    if spare(docs, name) != name:
        raise ValueError(f"documents have a column {name!r} already")
    found, whose, row = repeats(docs, id, text, **how), spare(docs, "whose"), spare(docs, "row")
    found = found.select(F.col("doc").alias(whose), F.col("row").alias(row), F.col("spans").alias(name))
    same = docs[key(id)].eqNullSafe(found[key(whose)]) & (row_key(docs[key(text)]) == found[key(row)])
    joined = docs.join(found, same, "left")
    return joined.select(*[docs[key(c)] for c in docs.columns], key(name))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the repeated passages: texts that have some become the words kept,
    joined by one space; other texts and columns stay as they are."""
    name = spare(docs, "spans")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        window = how.get("window", WINDOW)
        return pd.Series([
            b" ".join(kept_words(t, s, window)[1]).decode() for t, s in zip(texts, spans, strict=True)
        ], dtype=object)

    found = with_spans(docs, name, id, text, **how)
    cleaned = F.when(F.col(key(name)).isNull(), F.col(key(text))).otherwise(
        rest(F.col(key(text)), F.col(key(name)))
    )
    return found.select(*[cleaned.alias(c) if c == text else F.col(key(c)) for c in docs.columns])


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""
    window = how.get("window", WINDOW)

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def told(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for one, span in zip(texts, spans, strict=True):
            n, kept = kept_words(one, span, window)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col(key(id)).alias("doc_id"), F.col(key(text)).alias("text"))
    found = with_spans(own, "spans", **how)
    found = found.withColumn("told", told(F.col("text"), F.col("spans")))
    return found.select(F.col("doc_id").alias(id), "told.n_words", "told.n_removed", "told.kept_sha256")
