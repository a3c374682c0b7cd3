"""Suffix-array dedup (8): passages of MIN_WORDS words or more that occur elsewhere, by a distributed difference-cover sort.

1. Candidates. Two equal windows of MIN_WORDS words have the same smallest hash of GRAM words in them, so a window whose
   smallest hash occurs once in the corpus is repeated nowhere and need not be sorted. This loses nothing. The words of
   the other windows, run after run with gaps between, are the text S that is sorted. It is kept by bucket of documents.
2. Down. The positions 1 and 2 modulo 3 of S are the difference cover. Their triples of symbols are sorted by range, and
   ranks among the different triples become the symbols of a text of two thirds of the length, which is treated likewise until
   a symbol stands for MIN_WORDS words or more (3, 9, 27, 81: LEVELS is 4). Its names then are the order of its suffixes, as
   far as any comparison here looks.
3. Up. With the ranks of the sampled suffixes known, the others sort by (symbol, rank of the next suffix), and the two lists
   are merged with the comparisons of the difference cover: against position 1 modulo 3 by (symbol, next rank), against 2
   modulo 3 by (two symbols, rank after those).
4. Neighbours in the final order are compared by their prefixes of MIN_WORDS words; runs of equal prefixes are repeats.

Rows between tasks are blobs: a task sorts its items to their target partition with numpy and sends one row to each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .durable import table
from .names import free
from .textops import Words, buffers, mix, prefix, slices, spans, trim

MIN_WORDS = 50
#: Bytes of text to a bucket, about, and symbols to a range of the sort.
BUCKET_BYTES = 16 << 20
RANGE_SYMBOLS = 800_000
#: Sampled triples for each range, from which the ranges' bounds are taken.
OVERSAMPLE = 24
#: The most ranges, and the most triples sampled: what the driver gathers and sends does not grow beyond. In a text of more than
#: RANGES * RANGE_SYMBOLS symbols ranges are larger.
RANGES = 1 << 17
SAMPLES = 1 << 20
LOCAL = np.uint64(40)  # bits of an item's number within its range
PLACE = np.uint64(30)  # bits of a position within its bucket
FLUSH = 1_000_000
_EMPTY = np.zeros(0, np.uint64)


def pack(columns: list[np.ndarray]) -> bytes:
    """uint64 columns of one length, each by planes of as many bytes as its largest value needs."""
    n = len(columns[0])
    out, width = [], []
    for c in columns:
        k = max(1, (int(c.max()).bit_length() + 7) // 8) if n else 1
        width.append(k)
        out.append(np.ascontiguousarray(np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(n, 8)[:, :k].T).tobytes())
    return np.array([n, len(columns)], "<u8").tobytes() + bytes(width) + b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(data, "<u8", 2))
    width, at, out = data[16 : 16 + k], 16 + k, []
    for w in width:
        c = np.zeros((n, 8), np.uint8)
        c[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        at += n * w
        out.append(c.view("<u8").reshape(n).astype(np.uint64, copy=False))
    return out


def _blobs(column: pa.ChunkedArray) -> list[bytes]:
    return [x.as_py() for x in column]


def _concat(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)]


def _send(part: np.ndarray, columns: list[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """One row for each part, with its items' columns."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    rows: list[bytes] = []
    for a, b in zip(cut[:-1], cut[1:]):
        rows.append(pack([c[a:b] for c in columns]))
    if rows:
        yield pa.RecordBatch.from_pydict({name: pa.array(part[cut[:-1]].astype(np.int64)), "data": pa.array(rows, pa.binary())})


def slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """out[i] = f over x[i : i + w], where that lies within x; the last w - 1 are partial."""
    out, s = x.copy(), 1
    while s * 2 <= w:
        out[:-s] = f(out[:-s], out[s:])
        s *= 2
    if w > s and len(out) > w - s:
        out[: -(w - s)] = f(out[: -(w - s)], out[w - s :])
    return out


def minima(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hash of the grams in each window of `size` words, 0 where the window isn't within one text; hash by gram)."""
    n, gram = len(words), size // 2
    if n < size:
        return _EMPTY, _EMPTY
    start = np.arange(n - gram + 1)
    h = spans(prefix(words.hash), start, start + gram) | np.uint64(1)
    m = slide(h, size - gram + 1, np.minimum)[: n - size + 1]
    m[words.doc[: n - size + 1] != words.doc[size - 1 :]] = 0
    return m, h


def selected(m: np.ndarray, h: np.ndarray, size: int) -> np.ndarray:
    """Positions of the grams that are the least of some window."""
    w = size - size // 2 + 1
    pad = np.zeros(w - 1, np.uint64)
    most = slide(np.concatenate([pad, m, pad]), w, np.maximum)[: len(h)]
    return np.flatnonzero((most == h) & (most > 0))


def _grams(batches: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(hash, key of the text, word) of the least grams, by hash."""
    held: list[list[np.ndarray]] = []
    for b in slices(batches):
        words = Words(b.column("text"), "ascii")
        m, h = minima(words, size)
        if len(m):
            p = selected(m, h, size)
            held.append([h[p], b.column("key").to_numpy().view(np.uint64)[words.doc[p]], (p - words.first[words.doc[p]]).astype(np.uint64)])
        if sum(len(x[0]) for x in held) > FLUSH:
            cols = _concat(held)
            held = []
            yield from _send((mix(cols[0]) % np.uint64(parts)).astype(np.int64), cols, "part")
    if held:
        cols = _concat(held)
        yield from _send((mix(cols[0]) % np.uint64(parts)).astype(np.int64), cols, "part")


def _repeated(group: pa.Table, buckets: int) -> pa.Table:
    """By bucket of texts, the grams that occur again: in another text, or again in the same, but not in a copy of it."""
    h, key, word = _concat([unpack(x) for x in _blobs(group.column("data"))])
    order = np.lexsort((word, key, h))
    h, key, word = h[order], key[order], word[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (word[1:] != word[:-1])])
    h, key = h[new], key[new]
    same = h[1:] == h[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    h, bucket = h[again], key[again].view(np.int64) % buckets
    out = list(_send(bucket, [h], "bucket"))
    return pa.Table.from_batches(out) if out else pa.table({"bucket": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})


BLOB = "data binary"
#: A bucket of S: its symbols and their number; of each of its runs where it begins, the text's two keys, the least id and the first
#: word; of each text that several ids have: keys, least id and number of words. Together the keys are 128 bits.
HOME = "bucket bigint, n bigint, syms binary, runs binary, full binary"
NO_ID = np.int64((1 << 63) - 1)


def _bucket(key: tuple, texts: pa.Table, grams: pa.Table, size: int) -> pa.Table:
    """Of the bucket's different texts, the runs of words in windows whose least gram occurs again."""
    if not texts.num_rows:
        return pa.table({})
    bucket = key[0].as_py()
    known = np.unique(np.concatenate([unpack(x)[0] for x in _blobs(grams.column("data"))])) if grams.num_rows else _EMPTY
    keys, keys2, least, copied = (texts.column(c).to_numpy() for c in ("key", "key2", "least", "copied"))
    keys, keys2, least = keys.view(np.uint64), keys2.view(np.uint64), least.view(np.uint64)
    syms, run_at, run_text, run_word, full, where, base = [], [], [], [], [], 0, 0
    gap = np.zeros(3, np.uint64)
    for b in slices(iter(texts.select(["text"]).to_batches())):
        words = Words(b.column("text"), "ascii")
        count = np.diff(words.first)
        twice = base + np.flatnonzero(copied[base : base + b.num_rows] & (count >= size))
        full.append([keys[twice], keys2[twice], least[twice], count[twice - base].astype(np.uint64)])
        m, _ = minima(words, size)
        start = np.flatnonzero((m > 0) & np.isin(m, known)) if len(m) and len(known) else np.zeros(0, np.int64)
        if len(start):
            new = np.concatenate([[True], (start[1:] > start[:-1] + size) | (words.doc[start[1:]] != words.doc[start[:-1]])])
            first = start[new]
            last = np.append(start[:-1][new[1:]], start[-1]) + size
            for a, z in zip(first.tolist(), last.tolist()):
                syms += [words.hash[a:z], gap]
                run_at.append(where)
                run_text.append(base + words.doc[a])
                run_word.append(a - words.first[words.doc[a]])
                where += z - a + 3
        base += b.num_rows
    s = np.concatenate([*syms, gap]) if syms else _EMPTY
    if len(s) >= 1 << int(PLACE):  # a bucket is BUCKET_BYTES and at most one text of up to 2 GB more, which has fewer words
        raise OverflowError(f"bucket {bucket} has {len(s)} words")
    text = np.array(run_text, np.int64)
    runs = pack([np.array(run_at, np.uint64), keys[text], keys2[text], least[text], np.array(run_word, np.uint64)])
    return pa.table({"bucket": [bucket], "n": [len(s)], "syms": pa.array([pack([s])], pa.binary()), "runs": pa.array([runs], pa.binary()), "full": pa.array([pack(_concat(full))], pa.binary())})


def _sampled(bucket: int, s: np.ndarray, rate: float) -> bytes:
    """Triples at random positions of s, about len(s) * rate of them."""
    n = len(s) - 2
    pick = np.random.RandomState(bucket % (1 << 31)).randint(0, n, max(1, math.ceil(n * rate))) if n > 0 else np.zeros(0, np.int64)
    return pack([s[pick], s[pick + 1], s[pick + 2]]) if n > 0 else pack([_EMPTY] * 3)


def _order(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.lexsort((c, b, a))


class Ranges:
    """Bounds between ranges of triples."""

    def __init__(self, home: DataFrame, parts: int):
        got = [unpack(x) for x in _blobs(home.select("sample").toArrow().column("sample"))] if parts > 1 else []
        t = _concat(got) if got else [_EMPTY] * 3
        o = _order(*t)
        pick = o[np.arange(1, parts) * len(o) // parts] if len(o) else o
        self.bounds = [x[pick] for x in t]
        self.parts = parts

    def __call__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Number of bounds below or at each triple; equal triples share a range."""
        x, y, z = self.bounds
        lo, hi = np.searchsorted(x, a, "left"), np.searchsorted(x, a, "right")
        out = lo.copy()
        for i in np.unique(lo[hi > lo]):  # bounds that share their first symbol
            at = np.flatnonzero((lo == i) & (hi > lo))
            j = hi[at[0]]
            k = np.arange(i, j)
            less = (y[k][None, :] < b[at][:, None]) | ((y[k][None, :] == b[at][:, None]) & (z[k][None, :] <= c[at][:, None]))
            out[at] = i + less.sum(1)
        return out


def _symbols(row: dict, level: int) -> np.ndarray:
    """S of a bucket as it is compared: at level 0 a word's symbol is the upper half of its hash."""
    s = unpack(row["syms"])[0]
    return np.where(s > 0, np.maximum(s >> np.uint64(32), 1), 0) if level == 0 else s


def _samples(batches: Iterator[pa.RecordBatch], rate: float) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        yield pa.RecordBatch.from_pydict({"sample": pa.array([_sampled(row["bucket"], _symbols(row, 0), rate)], pa.binary())})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(name)[k].as_py() for name in b.schema.names}


def _positions(bucket: int, at: np.ndarray) -> np.ndarray:
    return np.uint64(bucket) << PLACE | at.astype(np.uint64)


def _gathered(columns: Iterator[tuple[np.ndarray, list[np.ndarray]]], name: str = "part") -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []
    size = 0
    for part, cols in columns:
        held.append((part, cols))
        size += len(part)
        if size > FLUSH:
            yield from _send(np.concatenate([p for p, _ in held]), _concat([c for _, c in held]), name)
            held, size = [], 0
    if held:
        yield from _send(np.concatenate([p for p, _ in held]), _concat([c for _, c in held]), name)


def _triples(batches: Iterator[pa.RecordBatch], level: int, ranges: Ranges) -> Iterator[pa.RecordBatch]:
    """The sampled positions' triples, by range, with their places in the next level's text. Gaps have none."""

    def each():
        for row in _rows(batches):
            s = _symbols(row, level)
            at = np.arange(len(s) - 2)
            at = at[(at % 3 != 0) & (s[at] > 0)]
            if len(at):
                t = s[at], s[at + 1], s[at + 2]
                yield ranges(*t), [*t, _positions(row["bucket"], _below(at, len(s)))]

    return _gathered(each())


def _empty(name: str) -> pa.Table:
    return pa.table({name: pa.array([], pa.int64()), "data": pa.array([], pa.binary())})


def _home(pos: np.ndarray, rank: np.ndarray) -> pa.Table:
    """(place, rank) sent back to the positions' buckets."""
    trim()
    out = list(_send((pos >> PLACE).astype(np.int64), [pos & np.uint64((1 << int(PLACE)) - 1), rank], "bucket"))
    return pa.Table.from_batches(out) if out else _empty("bucket")


def _name(key: tuple, group: pa.Table) -> pa.Table:
    """A range's triples sorted and named: rank among the different ones, above those of lower ranges; never 0."""
    a, b, c, pos = _concat([unpack(x) for x in _blobs(group.column("data"))])
    o = _order(a, b, c)
    a, b, c, pos = a[o], b[o], c[o], pos[o]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    return _home(pos, (np.uint64(key[0].as_py()) << LOCAL) + np.cumsum(new).astype(np.uint64))


def _below(at: np.ndarray, n: int) -> np.ndarray:
    """Places in the next level's text of the sampled positions of a text of n symbols: 1 modulo 3, a gap, 2 modulo 3."""
    return np.where(at % 3 == 1, 0, len(range(1, n - 2, 3)) + 3) + at // 3


def _next(key: tuple, group: pa.Table, rate: float) -> pa.Table:
    """The next level's text of a bucket."""
    bucket = key[0].as_py()
    place, name = _concat([unpack(x) for x in _blobs(group.column("data"))])
    s = np.zeros(int(place.max()) + 4, np.uint64)
    s[place.astype(np.int64)] = name
    return pa.table({"bucket": [bucket], "syms": pa.array([pack([s])], pa.binary()), "sample": pa.array([_sampled(bucket, s, rate)], pa.binary())})


def _ranks(data: list[bytes], n: int) -> np.ndarray:
    """Rank by place of a text of n symbols."""
    out = np.zeros(n, np.uint64)
    if data:
        place, rank = _concat([unpack(x) for x in data])
        out[place.astype(np.int64)] = rank
    return out


def _unfold(s_len: int, rank_next: np.ndarray) -> np.ndarray:
    """Ranks by position of a text from those of the next level's text, whose suffixes are its sampled ones."""
    n = s_len - 2
    n1, n2 = len(range(1, n, 3)), len(range(2, n, 3))
    out = np.zeros(s_len + 3, np.uint64)
    out[1:n:3] = rank_next[:n1]
    out[2:n:3] = rank_next[n1 + 3 : n1 + 3 + n2]
    return out


def _merge(kind: np.ndarray, t0: np.ndarray, t1: np.ndarray, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """Index in the merged order of all suffixes of a range. kind: position modulo 3. ra: of 0 the rank of the next suffix, of
    others their own rank. rb: the rank two further for 0 and 2, of the next for 1."""
    index = np.zeros(len(kind), np.int64)
    zero, one, two = (np.flatnonzero(kind == k) for k in range(3))
    both = np.concatenate([one, two])
    both = both[np.argsort(ra[both], kind="stable")]
    zero = zero[np.lexsort((ra[zero], t0[zero]))]
    index[both] = np.arange(len(both))
    index[zero] = np.arange(len(zero))

    def against(other: np.ndarray, *keys: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds to each side's index how many of the other side are before it; ties: zero first."""
        if not len(other) or not len(zero):
            return
        side = np.concatenate([np.zeros(len(zero), np.int8), np.ones(len(other), np.int8)])
        o = np.lexsort((side, *[np.concatenate([z[zero], x[other]]) for z, x in keys]))
        items, of = np.concatenate([zero, other])[o], side[o]
        before = np.cumsum(of)
        index[items[of == 0]] += before[of == 0]
        index[items[of == 1]] += (np.arange(1, len(o) + 1) - before)[of == 1]

    against(one, (ra, rb), (t0, t0))
    against(two, (rb, rb), (t1, t1), (t0, t0))
    return index


def _suffixes(s: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions and their (symbol, next symbol, ra, rb) for _merge."""
    at = np.arange(len(s) - 2)
    kind = at % 3
    ra = np.where(kind == 0, rank[at + 1], rank[at])
    rb = np.where(kind == 1, rank[at + 1], rank[at + 2])
    return at, [s[at], s[at + 1], ra, rb]


def _up(key: tuple, home: pa.Table, ranks: pa.Table, level: int, ranges: Ranges, size: int) -> pa.Table:
    """A bucket's suffixes with what the merge needs of them, by range; at level 0 also the prefix and the least id."""
    if not home.num_rows:
        return _empty("part")
    bucket = key[0].as_py()
    row = {n: home.column(n)[0].as_py() for n in home.column_names}
    s = _symbols(row, level)
    if len(s) < 3:
        return _empty("part")
    n1, n2 = len(range(1, len(s) - 2, 3)), len(range(2, len(s) - 2, 3))
    rank = _unfold(len(s), _ranks(_blobs(ranks.column("data")), n1 + n2 + 6))
    at, cols = _suffixes(s, rank)
    cols.append(_positions(bucket, at))
    if level == 0:
        words = unpack(row["syms"])[0]
        run_at, _, _, least, _ = unpack(row["runs"])
        h = np.zeros(len(at), np.uint64)
        full = np.arange(len(words) - size + 1)
        gap = np.concatenate([[0], np.cumsum(words == 0)])
        full = full[(gap[full + size] == gap[full]) & (full < len(at))]
        h[full] = spans(prefix(words), full, full + size) | np.uint64(1)
        run = np.searchsorted(run_at, at.astype(np.uint64), "right") - 1
        cols += [h, least[run] ^ np.uint64(1 << 63)]
    real = s[at] > 0
    at = at[real]
    out = list(_send(ranges(s[at], s[at + 1], s[at + 2]), [c[real] for c in cols], "part"))
    return pa.Table.from_batches(out) if out else _empty("part")


def _ranked(key: tuple, group: pa.Table) -> pa.Table:
    t0, t1, ra, rb, pos = _concat([unpack(x) for x in _blobs(group.column("data"))])
    kind = (pos & np.uint64((1 << int(PLACE)) - 1)) % np.uint64(3)
    return _home(pos, (np.uint64(key[0].as_py()) << LOCAL) + _merge(kind, t0, t1, ra, rb).astype(np.uint64) + np.uint64(1))


def _neighbours(group: pa.Table) -> pa.Table:
    """The range's suffixes in order; neighbours of equal prefix are repeats. To their buckets: place, and 1 for the first of its
    like (by least id of the text, then by position), 2 for the others."""
    t0, t1, ra, rb, pos, h, least = _concat([unpack(x) for x in _blobs(group.column("data"))])
    kind = (pos & np.uint64((1 << int(PLACE)) - 1)) % np.uint64(3)
    o = np.argsort(_merge(kind, t0, t1, ra, rb), kind="stable")
    o = o[h[o] > 0]
    h, pos, least = h[o], pos[o], least[o]
    if not len(h):
        return _empty("bucket")
    block = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    again = np.bincount(block)[block] > 1
    block, pos, least = block[again], pos[again], least[again]
    o = np.lexsort((pos, least, block))
    first = np.concatenate([[True], block[o][1:] != block[o][:-1]]) if len(o) else np.zeros(0, bool)
    return _home(pos[o], np.where(first, 1, 2).astype(np.uint64))


def _covered(start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the union of windows [start, start + size); start ascends."""
    if not len(start):
        return start, start
    new = np.concatenate([[True], start[1:] > start[:-1] + size])
    return start[new], np.append(start[:-1][new[1:]], start[-1]) + size


SPANS = "key bigint, key2 bigint, first_word int, end_word int, cut boolean"


def _spans(key: tuple, home: pa.Table, marks: pa.Table, size: int) -> pa.Table:
    """By text: spans of words covered by repeats (cut false), and of those that aren't the first of their like (cut true)."""
    out: list[list[np.ndarray]] = []
    if home.num_rows and marks.num_rows:
        run_at, text, text2, _, word = unpack(home.column("runs")[0].as_py())
        place, mark = _concat([unpack(x) for x in _blobs(marks.column("data"))])
        o = np.argsort(place)
        place, mark = place[o], mark[o]
        for cut in (False, True):
            a, z = _covered(place[mark == 2].astype(np.int64) if cut else place.astype(np.int64), size)
            run = np.searchsorted(run_at, a.astype(np.uint64), "right") - 1
            shift = word[run].astype(np.int64) - run_at[run].astype(np.int64)
            out.append([text[run].view(np.int64), text2[run].view(np.int64), a + shift, z + shift, np.full(len(a), cut)])
    k, k2, a, z, cut = _concat(out) if out else [np.zeros(0, np.int64)] * 5
    return pa.table({"key": pa.array(k, pa.int64()), "key2": pa.array(k2, pa.int64()), "first_word": pa.array(a.astype(np.int32)), "end_word": pa.array(z.astype(np.int32)), "cut": pa.array(cut.astype(bool))})


def _fulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        k, k2, least, n = unpack(row["full"])
        yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "key2": pa.array(k2.view(np.int64)), "least": pa.array(least.view(np.int64)), "words": pa.array(n.astype(np.int32))})


KEYS = ["key", "key2"]


def _keys(text: str) -> tuple:
    """Two hashes of a text; texts that differ in neither are taken for the same."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), F.col(text))


def _totals(df: DataFrame, text: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def _levels(size: int) -> int:
    level = 1
    while 3**level < size:
        level += 1
    return level


class Repeats:
    """The tables of one run: spans by text key, and the texts that occur whole more than once."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int):
        shuffle = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(shuffle, math.ceil(_totals(docs, text_col) / BUCKET_BYTES))
        d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).withColumns(dict(zip(("key", "key2"), _keys("text"))))
        grams = d.select("key", "text").mapInArrow(lambda it: _grams(it, size, buckets), f"part bigint, {BLOB}")
        known = grams.groupBy("part").applyInArrow(lambda t: _repeated(t, buckets), f"bucket bigint, {BLOB}")
        copied = (F.min("id") != F.max("id")) | ((F.count("id") > 0) & (F.count("id") < F.count("*")))
        texts = d.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets))).repartition("bucket").groupBy("bucket", "key", "key2").agg(F.first("text").alias("text"), F.coalesce(F.min("id"), F.lit(int(NO_ID))).alias("least"), F.coalesce(copied, F.lit(False)).alias("copied"))
        homes = [table(_cogroup(texts, known, lambda k, t, g: _bucket(k, t, g, size), HOME), "home0")]
        n = homes[0].df.agg(F.sum("n")).first()[0] or 0
        rate = min(OVERSAMPLE / RANGE_SYMBOLS, SAMPLES / max(1, n))
        levels, ranges = _levels(size), []
        for level in range(levels):
            sample = homes[0].df.select("bucket", "syms").mapInArrow(lambda it: _samples(it, rate), "sample binary") if level == 0 else homes[level].df
            r = Ranges(sample, min(RANGES, max(1, math.ceil(n * (2 / 3) ** level / RANGE_SYMBOLS))))
            ranges.append(r)
            named = homes[level].df.select("bucket", "syms").mapInArrow(lambda it, level=level, r=r: _triples(it, level, r), f"part bigint, {BLOB}").groupBy("part").applyInArrow(_name, f"bucket bigint, {BLOB}")
            homes.append(table(named.groupBy("bucket").applyInArrow(lambda k, t: _next(k, t, rate), "bucket bigint, syms binary, sample binary"), f"home{level + 1}"))
        ranks = table(homes[levels].df.select("bucket", "syms").mapInArrow(_own, f"bucket bigint, {BLOB}"), "ranks")
        homes.pop().drop()
        for level in reversed(range(levels)):
            home = homes[level].df.select("bucket", "syms", "runs") if level == 0 else homes[level].df.select("bucket", "syms")
            sent = _cogroup(home, ranks.df, lambda k, h, x, level=level: _up(k, h, x, level, ranges[level], size), f"part bigint, {BLOB}")
            new = table(sent.groupBy("part").applyInArrow(_ranked if level else _neighbours, f"bucket bigint, {BLOB}"), f"ranks{level}")
            ranks.drop()
            ranks = new
            if level:
                homes.pop().drop()
        home = homes[0].df
        self.spans = table(_cogroup(home.select("bucket", "runs"), ranks.df, lambda k, h, m: _spans(k, h, m, size), SPANS), "spans").df
        self.full = table(home.select("full").mapInArrow(_fulls, "key bigint, key2 bigint, least bigint, words int"), "full").df
        ranks.drop()
        homes[0].drop()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last level's names as ranks of its places."""
    for row in _rows(batches):
        s = unpack(row["syms"])[0]
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([row["bucket"]], pa.int64()), "data": pa.array([pack([at.astype(np.uint64), s[at]])], pa.binary())})


def _cogroup(left: DataFrame, right: DataFrame, f, schema: str, by: str = "bucket") -> DataFrame:
    """f of each key's rows of both sides, where the left side has some."""
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def call(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        got = f(k, a, b)
        return got if got.num_columns else empty

    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(call, schema)


def _found(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """find_repeats, with the key of the text."""
    r = Repeats(docs, id_col, text_col, size)
    one = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), *[k.alias(n) for k, n in zip(_keys(text_col), KEYS)]).distinct()
    d = one.join(r.full, KEYS, "left")
    many, other = F.col("least").isNotNull(), F.coalesce(F.col("doc_id"), F.lit(int(NO_ID))) != F.col("least")
    flags = F.when(other, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    whole = d.where(many).select("doc_id", *KEYS, F.lit(0).alias("first_word"), F.col("words").alias("end_word"), F.explode(flags).alias("cut"))
    part = d.join(r.spans, KEYS).where(~many | (F.col("cut") & ~other)).select("doc_id", *KEYS, "first_word", "end_word", "cut")
    return whole.unionByName(part)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first_word, end_word (words of the text, from 0, the end exclusive) and cut, for every document and every maximal
    span in it that windows of min_words words cover which occur elsewhere, in another document or again in this one (cut
    false); and the same of the windows that are not the first of their like (cut true).

    Words are runs of ASCII letters, ASCII digits and characters beyond ASCII; ASCII case doesn't count. First is the occurrence
    in the document with the smallest id (null is largest), of these one that is chosen by hash of the text, and the earliest
    within a text. A text that several ids have is a repeat as a whole, if it has min_words words, and all of it is cut but
    in the row of the smallest id. Repeated rows, equal in id and text, count as one document. Null, empty and shorter texts
    have no span. Other columns are not read, no rows give no rows."""
    return _found(docs, id_col, text_col, min_words).drop(*KEYS)


def _cut(texts: pa.Array, spans_of: list) -> tuple[list, np.ndarray]:
    """Texts without the words of their spans (pairs of word numbers), and whether one has no word left."""
    raw, offsets = buffers(texts)
    words = Words(texts, "ascii")
    out, bare = [], np.zeros(len(texts), bool)
    for i, s in enumerate(spans_of):
        if s is None or not len(s):
            out.append(texts[i].as_py())
            continue
        lo, hi = words.first[i], words.first[i + 1]
        keep, at = [], offsets[i]
        left = hi - lo
        for a, z in sorted((int(x["first_word"]), int(x["end_word"])) for x in s):
            keep.append(raw[at : words.start[lo + a]].tobytes())
            at = words.start[lo + z] if lo + z < hi else offsets[i + 1]
            left -= z - a
        keep.append(raw[at : offsets[i + 1]].tobytes())
        out.append(b"".join(keep).decode("utf-8"))
        bare[i] = left <= 0
    return out, bare


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans that find_repeats calls cut taken out of the texts, up to the word after them; chars_col, if docs has
    it, is the new length of a text that was cut. A row of which no word is left goes. All other rows and columns stay."""
    spans_name, id_name, key_name, key2_name = free(docs, "spans", "span_id", "span_key", "span_key2")
    found = _found(docs, id_col, text_col, min_words).where("cut")
    cuts = found.groupBy(F.col("doc_id").alias(id_name), F.col("key").alias(key_name), F.col("key2").alias(key2_name)).agg(F.collect_list(F.struct("first_word", "end_word")).alias(spans_name))
    joined = docs.join(cuts, (_keys(text_col)[0] == F.col(key_name)) & (_keys(text_col)[1] == F.col(key2_name)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(id_name)), "left")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts, bare = _cut(b.column(text_col), b.column(spans_name).to_pylist())
            cols = {}
            for c in schema.names:
                v = b.column(c)
                if c == text_col:
                    v = pa.array(texts, v.type)
                elif c == chars_col:
                    was = b.column(spans_name).is_valid().to_numpy(zero_copy_only=False)
                    v = pa.array([len(t) if w else o for t, w, o in zip(texts, was, v.to_pylist())], v.type)
                cols[c] = v
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols)).filter(pa.array(~bare))

    return joined.mapInArrow(run, schema)


#: The same from all windows, for documents whose ids are unique.
ORACLE_SQL = f"""
WITH u AS MATERIALIZED (SELECT text, min(doc_id) AS least, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS MATERIALIZED (SELECT least, text, copies, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM u),
p AS (SELECT least, words, unnest(generate_series(0, len(words) - {MIN_WORDS})) AS p FROM w WHERE len(words) >= {MIN_WORDS}),
k AS (SELECT least, p, md5(array_to_string(words[p + 1:p + {MIN_WORDS}], ' ')) AS k FROM p),
m AS MATERIALIZED (SELECT * FROM (SELECT least, p, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY least, p) AS r FROM k) WHERE n > 1),
marks AS (SELECT least, p, false AS cut FROM m UNION ALL SELECT least, p, true FROM m WHERE r > 1),
runs AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY least, cut ORDER BY p) + {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM marks),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY least, cut ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM runs),
spans AS (SELECT least, cut, min(p) AS first_word, max(p) + {MIN_WORDS} AS end_word FROM numbered GROUP BY least, cut, run)
SELECT doc_id, 0 AS first_word, len(words)::INTEGER AS end_word, c.cut FROM documents JOIN w USING (text) JOIN (VALUES (false), (true)) c(cut) ON c.cut = false OR doc_id <> least
  WHERE copies > 1 AND len(words) >= {MIN_WORDS}
UNION ALL
SELECT least AS doc_id, first_word::INTEGER, end_word::INTEGER, cut FROM spans JOIN w USING (least) WHERE copies = 1 OR cut
"""
