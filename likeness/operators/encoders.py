"""Encoders: callables from a list of texts to a matrix, run over Arrow batches.

A real model is brought by the user as a factory that loads it once per worker. The
module travels by value, so executors need no copy of the package.
"""

from __future__ import annotations

import hashlib
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Texts per model call.
MODEL_BATCH = 64
POOLED_BATCH = 32

WORD_BREAK = r"[ \t\r\n]+"


def masked_mean(hidden, mask):
    """Token states (text × token × width) averaged over the tokens that count."""
    weights = np.asarray(mask, dtype=hidden.dtype)[:, :, None]
    return (hidden * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), 1)


class PooledEncoder:
    """Mean pooling over a model's token states, for models without their own pooling.

    ``tokenize`` maps a text to token ids, ``states`` maps (ids, mask), both text ×
    token, to token states. Texts are cut at ``max_tokens`` where the model asks for it.
    """

    def __init__(self, tokenize, states, batch=POOLED_BATCH, max_tokens=None, pad=0):
        self.tokenize, self.states = tokenize, states
        self.batch, self.max_tokens, self.pad = batch, max_tokens, pad

    def __call__(self, texts):
        found = []
        for start in range(0, len(texts), self.batch):
            tokens = [self.tokenize(t)[: self.max_tokens] for t in texts[start : start + self.batch]]
            width = max(1, *map(len, tokens))
            ids = np.full((len(tokens), width), self.pad, dtype=np.int64)
            mask = np.zeros((len(tokens), width), dtype=np.int64)
            for line, row in enumerate(tokens):
                ids[line, : len(row)] = row
                mask[line, : len(row)] = 1
            found.append(masked_mean(self.states(ids, mask), mask))
        return np.concatenate(found)


class Places(dict):
    """The hashed position of each word met; -1 for the empty one."""

    def __init__(self, dim):
        super().__init__()
        self.dim = dim

    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        head = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        self[word] = head % self.dim if word else -1
        return self[word]


class HashingEncoder:
    """Word counts in hashed positions: needs no model, and knows no meaning."""

    def __init__(self, dim=768):
        self.dim = dim
        self.places = Places(dim)

    def __call__(self, texts):
        split = [re.split(WORD_BREAK, (text or "").lower()) for text in texts]
        words = list(chain.from_iterable(split))
        line = np.repeat(np.arange(len(texts)), list(map(len, split)))
        place = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        spot = (line * self.dim + place)[place >= 0]
        counts = np.bincount(spot, minlength=len(texts) * self.dim)
        return counts.reshape(len(texts), self.dim).astype(np.float64)


def unit(rows):
    rows = np.asarray(rows, dtype=np.float64)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    lengths[lengths <= 0] = 1.0
    return rows / lengths[:, None]


def encode_batches(factory, text, names, batch_size):
    """Map over Arrow batches: adds the unit vector of column ``text``."""

    def run(batches):
        encoder = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                rows = unit(encoder(part[text].to_pylist())).astype(np.float32)
                ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                vector = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
                yield pa.record_batch(
                    [vector if n == "vector" else part[n] for n in names], names=names
                )

    return run
