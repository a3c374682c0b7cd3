"""What turns texts into vectors, chosen by whoever builds the engine. There is no model here: without an embedder, indexing and
semantic search are errors, and the hash embedder is used only where it is asked for by name."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import MIN_NORM, hash_embeddings


class EmbeddingError(RuntimeError):
    pass


class Embedder(Protocol):
    """backend_id names the backend, is_semantic says whether near vectors mean near texts. Instances are sent to executors."""

    backend_id: str
    dim: int
    is_semantic: bool

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic and without meaning: for tests."""

    backend_id, is_semantic = "hash", False

    def __init__(self, dim: int):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        return hash_embeddings(texts, self.dim)


def select(candidates: list[Embedder], allow_mock: bool = False) -> Embedder:
    """The first semantic backend, or the first of any if mocks are allowed."""
    for c in candidates:
        if c.is_semantic:
            return c
    if allow_mock and candidates:
        return candidates[0]
    raise EmbeddingError("no embedding backend is configured")


def checked(vectors: np.ndarray, count: int, dim: int) -> np.ndarray:
    """Unit vectors, as many as texts, of the right dimension, finite and not zero."""
    v = np.asarray(vectors, np.float64)
    if v.shape != (count, dim):
        raise EmbeddingError(f"{v.shape} vectors for {count} texts of {dim} dimensions")
    n = np.linalg.norm(v, axis=1)
    if not np.isfinite(v).all() or not np.isfinite(n).all() or (n <= MIN_NORM).any():
        raise EmbeddingError("a vector has no direction")
    return (v / n[:, None]).astype(np.float32)


def embed_column(df: DataFrame, text_col: str, embedder: Embedder, batch: int = 32, out_col: str = "vector") -> DataFrame:
    """df with the unit vectors of a text column, embedded in batches on the executors."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = []
            for k in range(0, len(s), batch):
                texts = s.iloc[k : k + batch].tolist()
                out += list(checked(embedder.embed(texts), len(texts), embedder.dim))
            yield pd.Series(out)

    return df.withColumn(out_col, run(text_col))
