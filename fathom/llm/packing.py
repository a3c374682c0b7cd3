"""Packing (6): cost-balanced packing of documents into training sequences.

Tokens are those of the byte-level BPE (2), so what is packed is what is trained on: a document of T tokens is cut at token
borders, and no sequence holds more tokens than its capacity. A piece of n tokens costs n + n * n / QUADRATIC: the linear layers and the attention within the piece. Pieces are taken by
falling size; each goes to the sequence of lowest cost among those with room for it, and to a new one if none has room. So
sequences are full and cost about the same. Pieces are dealt by hash into shards of about SHARD_TOKENS tokens; each shard is
packed by one task, and a corpus of any size is many shards of the same size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .durable import table

#: Tokens to a sequence; a longer document is cut into pieces of as many.
SEQUENCE_TOKENS = 4096
#: Tokens at which attention costs as much as the linear layers: six times the model's width, here 4096.
QUADRATIC = 24_576
SHARD_TOKENS = 1 << 24

PACKED = "sequence bigint, doc_id bigint, piece int, first_token bigint, tokens int"


def assign(tokens: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each piece; tokens descends and is at most capacity. Of equal costs the lowest sequence is taken."""
    most = max(1, math.ceil(tokens.sum() / capacity))
    room, cost = np.full(most, capacity, np.int64), np.zeros(most)
    out = np.empty(len(tokens), np.int64)
    for i, n in enumerate(tokens.tolist()):
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] < n:
            at = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[at] -= n
        cost[at] += n + n * n / QUADRATIC
        out[i] = at
    return out


def _pack(key: tuple, group: pa.Table, capacity: int) -> pa.Table:
    group = group.sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    sequence = assign(group.column("tokens").to_numpy().astype(np.int64), capacity)
    return pa.table({"sequence": pa.array((key[0].as_py() << 32) + sequence), **{c: group.column(c) for c in ("doc_id", "piece", "first_token", "tokens")}})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """sequence, doc_id, piece, first_token and tokens, for every piece of every row of docs: of a document of T tokens piece k holds
    tokens k * capacity up to (k + 1) * capacity or T, of those that bpe.encode gives with the same vocabulary.

    A null or empty text has no token and no piece. Pieces of equal size are taken by doc_id, nulls last, then by piece, in
    their shard. Repeated rows are packed each for itself. Other columns are not read, no rows give no rows."""
    sized = bpe.sizes(docs, vocabulary, id_col, text_col).where(F.col("n") > 0)
    held = table(sized, "sizes")
    total = held.df.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_TOKENS))
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"), F.lit(capacity).cast("bigint")))
    pieces = held.df.select("doc_id", "n", "h", at.alias("first_token")).select(
        "doc_id",
        (F.col("first_token") / capacity).cast("int").alias("piece"),
        "first_token",
        F.least(F.lit(capacity), F.col("n") - F.col("first_token")).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("doc_id", "h", "first_token"), F.lit(shards)).alias("shard"),
    )
    return pieces.groupBy("shard").applyInArrow(lambda k, t: _pack(k, t, capacity), PACKED)
