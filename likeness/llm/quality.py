"""Quality rules by compression bands: repetitive and incompressible texts go.

A text's zstandard ratio (compressed bytes by UTF-8 bytes) must lie in a band that
depends on its length, and so must the ratio of each fixed chunk of it. Base rules on
word counts come first. Everything is measured on whole texts, one row at a time in
Arrow batches, so no group can be hot and a lost task is simply run again.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likeness.llm.common import key, spare

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 4096
LEVEL = 3
# Least length in bytes, then the lowest and highest ratio of texts of that length or
# more, up to the next row.
TEXT_BANDS = (
    (0, 0.0, 9.0),
    (256, 0.3, 0.95),
    (512, 0.4, 0.85),
    (1024, 0.42, 0.75),
    (2048, 0.42, 0.7),
    (4096, 0.39, 0.7),
    (16384, 0.36, 0.7),
    (65536, 0.32, 0.7),
)
# The share of a text's whole chunks outside this band must not exceed CHUNK_SHARE.
CHUNK_BAND = (0.35, 0.75)
CHUNK_SHARE = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunks long, chunks_out long"
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur more than once."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    pairs, kinds = ids[:-1] * len(index) + ids[1:], len(index) ** 2
    if kinds * len(index) >= 2**63:
        pairs = np.unique(pairs, return_inverse=True)[1]
        kinds = n
    windows = pairs[:-1] * len(index) + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[place] > 1
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= again
    return int(marked.sum())


def measured(text: str | None, compress, text_bands, chunk_band, chunk_share) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes: exactly at space and 0x09 to 0x0D
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    seen, dup_lines = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    repeated = repeat_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    ratio = len(compress(raw)) / len(raw) if raw else 0.0
    low, high = next((lo, hi) for least, lo, hi in reversed(text_bands) if len(raw) >= least)
    whole = [raw[i : i + CHUNK] for i in range(0, len(raw) - CHUNK + 1, CHUNK)]
    ratios = [len(compress(chunk)) / CHUNK for chunk in whole]
    out = sum(not chunk_band[0] <= r <= chunk_band[1] for r in ratios)
    kept = not failed and low <= ratio <= high and out <= chunk_share * len(whole)
    return (
        len(words), word_chars, n_symbols, dup_lines, repeated, failed, kept,
        ratio, len(whole), out,
    )


def with_quality(
    docs: DataFrame,
    text: str = "text",
    name: str = "quality",
    text_bands: Sequence[tuple[int, float, float]] = TEXT_BANDS,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE,
) -> DataFrame:
    """``docs`` with a struct of measures and the verdict ``kept``.

    Null and empty texts have no words and fail. Rows are judged one by one, so repeated
    rows get the same verdict, an empty table gives an empty table, and other columns
    are passed on as they are. ``name`` must not be a column of ``docs``.
    """

    @F.pandas_udf(MEASURES)
    def measure(texts: pd.Series) -> pd.DataFrame:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [measured(t, compress, text_bands, chunk_band, chunk_share) for t in texts]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    if spare(docs, name) != name:
        raise ValueError(f"documents have a column {name!r} already")
    return docs.withColumn(name, measure.asNondeterministic()(F.col(key(text))))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns."""
    name = spare(docs, "quality")
    return with_quality(docs, text, name).filter(F.col(name)["kept"]).select(*[key(c) for c in docs.columns])
