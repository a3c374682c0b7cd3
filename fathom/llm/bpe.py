"""Byte-level BPE (2): a sentencepiece model serialised from a vocabulary of ranks.

Every byte stands for a printable character, so a piece of bytes is a string; the model holds these strings in order of rank
with the negative rank as score, and a normaliser that changes nothing. Merging the adjacent pair of the best score then is
merging the pair of the lowest rank. Texts are cut into pre-tokens by the vocabulary's pattern, and these are encoded; ids
are ranks. Decoding looks pieces up and maps characters back to bytes. The tokenizer isn't trained here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices, trim

#: Ranks of a public vocabulary: lines of base64 bytes and rank. A parameter everywhere below.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose ids a task remembers, and their longest in characters.
REMEMBERED = 600_000
REMEMBERED_CHARS = 64
#: Pre-tokens encoded at once where only the number of ids is kept.
ENCODED = 4096


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next unused from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


CHARACTERS = byte_characters()
_TABLE = {b: c for b, c in enumerate(CHARACTERS)}
_BYTES = {ord(c): b for b, c in enumerate(CHARACTERS)}


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's byte strings in order of rank. Ranks must be 0, 1, 2 and so on."""
    with open(path, "rb") as f:
        ranks = sorted((int(b), base64.b64decode(a)) for a, b in (line.split() for line in f if line.strip()))
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [x for _, x in ranks]


def to_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TABLE)


_BETWEEN = to_characters("\ud800".encode("utf-8", "surrogatepass"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(pieces: list[bytes]) -> bytes:
    """The sentencepiece ModelProto: pieces, scored by negative rank, an unknown piece after them, BPE, identity normalisation."""
    body = [_field(1, _field(1, to_characters(x).encode()) + _field(2, -float(rank))) for rank, x in enumerate(pieces)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, -float(len(pieces))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces)) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(body) + unknown + _field(2, trainer) + _field(3, normaliser)


class Tokenizer:
    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.blank = regex.compile(r"\s").match
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}
        self.words: dict[str, int] = {}

    @cached_property
    def pieces(self) -> list[bytes]:
        return [self.processor.id_to_piece(k).translate(_BYTES).encode("latin-1") for k in range(self.processor.get_piece_size() - 1)]

    def _sizes(self, parts: list[str]) -> np.ndarray:
        """How many ids each pre-token has."""
        distinct = set(parts)
        if len(self.sizes) + len(distinct) > REMEMBERED:
            self.sizes.clear()
        new = [w for w in distinct if w not in self.sizes]
        # a lone surrogate is in no text, nor are its bytes in the UTF-8 of one
        written = to_characters("\ud800".join(new).encode("utf-8", "surrogatepass")).split(_BETWEEN) if new else []
        for k in range(0, len(new), ENCODED):
            self.sizes.update(zip(new[k : k + ENCODED], map(len, self.processor.encode(written[k : k + ENCODED], num_threads=1))))
        out = np.fromiter(map(self.sizes.__getitem__, parts), np.int64, len(parts))
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del self.sizes[w]
        return out

    def _after_space(self, words: list[str]) -> list[int]:
        """How many ids each word has with a space before it; -1 where that space may not begin a pre-token: before white space or nothing."""
        out = np.full(len(words), -1)
        cut = [k for k, w in enumerate(words) if w and (w[0].isalnum() or not self.blank(w))]
        if cut:
            parts = self.split(" " + " ".join(words[k] for k in cut))
            first = np.flatnonzero(np.fromiter((x[0] == " " for x in parts), bool, len(parts)))
            out[cut] = np.add.reduceat(self._sizes(parts), first)
        return out.tolist()

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """How many ids encode_all gives each text; a null counts as empty.

        A space before anything but white space begins a pre-token, and none goes on over it. So texts are cut there, and the pattern sees
        each distinct word once, and a text as a whole only if in it a space stands before white space or at the end. This holds for PATTERN."""
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        offsets, words = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        offsets -= offsets[0]
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes several times as long
        if len(self.words) + len(distinct) > REMEMBERED:
            self.words.clear()
        new = [w for w in distinct if w not in self.words]
        self.words.update(zip(new, self._after_space(new)))
        at = words.indices.to_numpy()
        size = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))[at]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del self.words[w]
        start, end = offsets[:-1], offsets[1:]
        total = lambda x: (lambda s: s[end] - s[start + 1])(np.concatenate([[0], np.cumsum(x)]))
        whole = total(size < 0) > 0
        heads = [t.as_py() if w else distinct[k] for t, w, k in zip(texts, whole.tolist(), at[start].tolist())]
        parts = [self.split(t) for t in heads]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        own = np.concatenate([[0], np.cumsum(self._sizes(list(chain.from_iterable(parts))))])
        return own[ends[1:]] - own[ends[:-1]] + np.where(whole, 0, total(size))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts. Pre-tokens that aren't known are encoded once for all of them; when too many are known, all are forgotten."""
        words = [self.split(t) for t in texts]
        distinct = set(chain.from_iterable(words))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        new = [w for w in distinct if w not in self.known]
        self.known.update(zip(new, self.processor.encode([to_characters(w.encode()) for w in new], num_threads=1)))
        ids = self.known.__getitem__
        out = [list(chain.from_iterable(map(ids, w))) for w in words]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del self.known[w]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8")


def _encoded(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    t = Tokenizer(sent.value)
    for b in slices(batches):
        texts = b.column("text").to_pylist()
        encoded = t.encode_all([x or "" for x in texts])
        null = np.array([x is None for x in texts])
        whole = [None if x is None else t.decode(ids) == x for x, ids in zip(texts, encoded)]
        n = np.array([len(ids) for ids in encoded])
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(n.sum()))
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "tokens": pa.array(n, pa.int32(), mask=null), "round_trip": pa.array(whole, pa.bool_()), "ids": ids})
    del t
    trim()


def _counted(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    t = Tokenizer(sent.value)
    for b in slices(batches):
        n = t.count_all(b.column("text"))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "h": b.column("h")})
    del t
    trim()


def sizes(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, n (how many tokens encode gives its text; 0 for a null or empty one) and h (a hash of the text)."""
    sent = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return d.mapInArrow(lambda it: _counted(it, sent), "doc_id bigint, n bigint, h bigint")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, tokens (how many), round_trip (whether they decode to the text) and ids.

    A null text has nulls, an empty one no tokens. Repeated rows are encoded each for itself, a null id stays null, other
    columns are not read, no rows give no rows. The driver reads the vocabulary; executors need no file."""
    sent = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lambda it: _encoded(it, sent), "doc_id bigint, tokens int, round_trip boolean, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of every row of encode's result; null ids give a null text, no ids an empty one. Ids that aren't in the
    vocabulary, or whose bytes are not UTF-8, are an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array([None if x is None else t.decode(x) for x in b.column("ids").to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
