"""Vector arithmetic, the checks on vectors, and the deterministic embedder for tests."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def reject_reason(v: Column, dim: int) -> Column:
    """Why a vector can't be stored: dimension, component or norm; null if it can."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = norm(v)
    return F.when(v.isNull() | (F.size(v) != dim), "dimension").when(bad, "component").when(F.isnan(n) | (n == float("inf")) | (n <= MIN_NORM), "norm")


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: (x.cast("double") / n).cast("float"))


#: Words whose buckets a worker keeps, and characters of text that are embedded at once.
KNOWN_WORDS, EMBED_CHARS = 1 << 18, 1 << 20


class _Words(dict):
    """The first six bytes of a word's SHA-256, as a number; computed when it is first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.sha256(word.encode()).digest()[:6], "little")
        return h


_words = _Words()


def hash_embeddings(texts: list[str], dim: int) -> np.ndarray:
    """A row a text: its words in hashed buckets, the k-th divided by k, added in their order. A blank text is the zero vector. Not a
    semantic embedding."""
    dim = max(1, dim)
    out = np.zeros((len(texts), dim), np.float32)
    at = 0
    while at < len(texts):
        split, chars = [], 0
        while at + len(split) < len(texts) and chars < EMBED_CHARS:
            t = texts[at + len(split)]
            chars += len(t)
            split.append(t.split())
        n = np.fromiter(map(len, split), np.int64, len(split))
        h = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(n.sum()))
        row = np.repeat(np.arange(len(split)), n)
        k = (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(np.float32)
        bucket, part = np.empty((len(h), 2), np.int64), np.empty((len(h), 2), np.float32)
        bucket[:, 0], bucket[:, 1] = row * dim + (h & 0xFFFF) % dim, row * dim + (h >> 16 & 0xFFFF) % dim
        part[:, 0], part[:, 1] = np.where(h >> 32 & 1, -1, 1).astype(np.float32) / k, np.where(h >> 40 & 1, -0.5, 0.5).astype(np.float32) / k
        np.add.at(out[at : at + len(split)].reshape(-1), bucket.reshape(-1), part.reshape(-1))  # one after the other, as in a loop
        at += len(split)
    return out


def hash_embedding(text: str, dim: int) -> np.ndarray:
    return hash_embeddings([text], dim)[0]


def embed_mock(df: DataFrame, text_col: str, dim: int, out_col: str = "vector") -> DataFrame:
    """df with hash_embedding of a text column, before normalisation."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(hash_embeddings([t or "" for t in texts], dim)))

    return df.withColumn(out_col, run(text_col))
