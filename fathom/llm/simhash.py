"""SimHash near-dedup (5): BK-trees over 128-bit SimHash codes.

A text's code has a bit set where most of its distinct words' hashes have it. Codes within RADIUS of each other are near.
Codes are spread over shards by masks: each of several tables looks at some bits of a code, and codes that agree in them share
a shard. The tables are a covering: the bits are cut into parts with a threshold each, such that of two codes within RADIUS
some part differs in no more bits than its threshold t; the part's bits have vectors of t + 1 bits, not 0, and there is a
table for each v but 0, of the bits whose vector has an odd product with v. Any t vectors have a v that is orthogonal to
them, so in its table the two codes agree. Hence every near pair shares a shard, whatever the corpus.

Each shard has a BK-tree, in which a root's children are keyed by their integer Hamming distance to it; every code queries
the tree of each of its shards and follows only edges within the radius, to lists of codes with which it is compared, many
by many. A tree goes where the queries for it are, rather
than to every executor: trees grow with the corpus. A shard of very many codes is cut into blocks, and each pair of blocks is
a tree of its own. Near codes are linked, and the groups are the connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import Table, table
from .names import free
from .textops import Words, mix, slices, trim, unique_terms

BITS = 128
RADIUS = 20
#: Thresholds + 1 of the parts, by table count; each adds up to RADIUS + 1. More tables have more bits, so smaller shards.
FAMILIES = ((4, 4, 4, 4, 4, 1), (5, 5, 5, 6), (7, 7, 7), (10, 11))
#: The first family is taken whose shards have so many codes on average, or fewer.
SHARD = 5_000
#: Codes of a shard beyond which it is cut into blocks of about as many, and the most shards that are.
HOT = 50_000
HOT_SHARDS = 1 << 20
#: The most codes of a tree that is one list.
LEAF = 64
#: Pairs that are compared at once, about: what the processor's cache holds.
BLOCK = 1 << 17
#: Entries (a code in a table) to a task, about.
ENTRIES = 1 << 21
LANES = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 2 words of code, distinct words) of each text; without a word the code is 0."""
    words = Words(texts)
    doc, term = unique_terms(words.doc, words.hash)
    n = np.bincount(doc, minlength=words.rows)
    out = np.zeros((words.rows, 2), np.uint64)
    if not len(doc):
        return out, n
    h = np.stack([mix(term), mix(term ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8)
    first = np.cumsum(n) - n
    place = np.arange(len(doc)) - first[doc]
    cut = np.flatnonzero(place % 255 == 0)  # a lane is a byte
    some = np.add.reduceat(LANES[h], cut, axis=0).view(np.uint8).reshape(len(cut), BITS).astype(np.int32)
    block_doc = doc[cut]
    at = np.flatnonzero(np.concatenate([[True], block_doc[1:] != block_doc[:-1]]))
    total = np.add.reduceat(some, at, axis=0)
    rows = block_doc[at]
    out[rows] = np.packbits(2 * total > n[rows, None], axis=1).view(np.uint64)
    return out, n


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances between rows of two codes."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """A BK-tree for each shard, all built at once. codes: n x 2; shard: ascending, of each code; same: bits of each code's first word
    in which its shard's codes agree. The root is the first code of a shard, its children are keyed by distance: a child is the first of the codes at a distance and has the others of it as a
    list, itself the root's (distance 0) like any other. A tree of at most LEAF codes is one list.

    There are no deeper levels: of codes about 60 bits apart nearly all edges are within RADIUS of each other, so that a level
    leaves out few codes, while codes in a list are compared at a tenth of the cost of following edges to each."""

    def __init__(self, codes: np.ndarray, shard: np.ndarray, same: np.ndarray | None = None):
        n = len(codes)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        self.root = np.repeat(first, size)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int16)
        tall = np.flatnonzero(np.repeat(size > LEAF, size))
        self.edge[tall] = distance(codes[tall], codes[self.root[tall]])
        tall = tall[np.argsort(self.root[tall] * (BITS + 1) + self.edge[tall], kind="stable")]  # trees after each other, each by distance
        new = np.ones(len(tall), bool)
        new[1:] = (self.root[tall[1:]] != self.root[tall[:-1]]) | (self.edge[tall[1:]] != self.edge[tall[:-1]])
        kids = tall[new & (self.root[tall] != tall)]
        self.parent[kids] = self.root[kids]
        self.kids = kids
        self.first = np.searchsorted(self.parent[kids], np.arange(n + 1))
        # places: tall trees by distance, then the others by falling size
        low = np.argsort(-np.repeat(size, size), kind="stable")
        self.tall = len(tall)
        self.order = np.concatenate([tall, low[len(tall) :]])
        self.hi, self.lo = codes[self.order, 0], codes[self.order, 1]
        # 64 bits of a code, with bits of the other word for those in which the tree's codes agree
        m = same[self.order] if same is not None else np.uint64(0)
        self.some = (self.hi & ~m) | (self.lo & m)
        self.sizes = size[size > LEAF], -np.sort(-size[size <= LEAF])

    def near(self, radius: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, node, distance), node < query, for every code as a query of its own tree; about `chunk` at a time or more."""
        held, n = [], 0
        for a, b in chain(self._followed(radius), self._lists(radius)):
            d = np.bitwise_count(self.hi[a] ^ self.hi[b]).astype(np.int64) + np.bitwise_count(self.lo[a] ^ self.lo[b])
            hit = np.flatnonzero(d <= radius)
            if len(hit):
                held.append((self.order[a[hit]], self.order[b[hit]], d[hit]))
                n += len(hit)
            if n >= chunk:
                a, b, d = (np.concatenate(c) for c in zip(*held))
                yield np.maximum(a, b), np.minimum(a, b), d
                held, n = [], 0
        if held:
            a, b, d = (np.concatenate(c) for c in zip(*held))
            yield np.maximum(a, b), np.minimum(a, b), d

    def _followed(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs in tall trees that may be near, from edges within the radius of each other: of a tree these are runs of places."""
        space, count = np.empty(BLOCK + 8, np.uint64), np.empty(BLOCK + 8, np.uint8)
        at = 0
        for n in self.sizes[0].tolist():
            edge = self.edge[self.order[at : at + n]]
            low = at + np.searchsorted(edge, edge - radius)
            row = at
            while row < at + n:
                begin = int(low[row - at])
                # rows of the block, each of which is compared with all before the last
                rows = max(1, min(64, BLOCK // (row + 64 - begin), at + n - row))
                for left in range(begin, row + rows, BLOCK):
                    right = min(left + BLOCK, row + rows)
                    width = right - left
                    cells = rows * width
                    np.bitwise_xor(self.some[row : row + rows, None], self.some[None, left:right], out=space[:cells].reshape(rows, width))
                    count[cells : cells + 8] = BITS
                    np.bitwise_count(space[:cells], out=count[:cells])
                    a, b = np.divmod(_at_most(count[: -(-cells // 8) * 8], radius), width)
                    a, b = a + row, b + left
                    once = b < a
                    yield a[once], b[once]
                row += rows
            at += n

    def _lists(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs in trees of one list that may be near: each place with the k-th before it, for many trees at once."""
        sizes = self.sizes[1]
        ends = np.cumsum(sizes)
        head = np.repeat(ends - sizes, sizes)  # the first place of a place's tree
        space, count = np.empty(BLOCK + LEAF + 8, np.uint64), np.empty(BLOCK + LEAF + 8, np.uint8)
        tree = 0
        while tree < len(sizes):
            after = max(tree + 1, int(np.searchsorted(ends, ends[tree] - sizes[tree] + BLOCK, "right")))
            begin = int(ends[tree] - sizes[tree])
            for k in range(1, int(sizes[tree])):
                longer = tree + int(np.searchsorted(-sizes[tree:after], -k, "left"))  # trees of more than k codes
                end = int(ends[longer - 1])
                cells = end - begin - k
                some = self.some[self.tall + begin : self.tall + end]
                np.bitwise_xor(some[k:], some[:-k], out=space[:cells])
                count[cells : cells + 8] = BITS
                np.bitwise_count(space[:cells], out=count[:cells])
                a = _at_most(count[: -(-cells // 8) * 8], radius) + begin + k
                a = a[a - k >= head[a]]
                yield a + self.tall, a + (self.tall - k)
            tree = after


def _at_most(count: np.ndarray, most: int) -> np.ndarray:
    """Where count is at most `most`; its length is a multiple of 8, and few are."""
    eight = (count <= most).view(np.uint64)
    some = np.flatnonzero(eight)
    which, at = np.nonzero(eight[some].view(bool).reshape(-1, 8))
    return some[which] * 8 + at


@lru_cache(maxsize=8)
def covering(family: tuple[int, ...], seed: int = 5) -> np.ndarray:
    """Masks (tables x 2 words) of which one at least misses every difference of up to RADIUS bits."""
    rng = np.random.RandomState(seed)
    share = np.array([(2**k - 1) / 2 ** (k - 1) for k in family])  # so that the tables of all parts look at about as many bits
    cut = np.round(np.cumsum(share) / share.sum() * BITS).astype(int)
    bits, out = rng.permutation(BITS), []
    for k, lo, hi in zip(family, [0, *cut[:-1]], cut):
        v = np.arange(1, 2**k)
        best, least = None, math.inf
        for _ in range(200):  # of some draws of vectors, the one with the fewest pairs that agree by chance
            draw = np.concatenate([rng.permutation(v) for _ in range(math.ceil((hi - lo) / len(v)))])[: hi - lo]
            odd = np.bitwise_count(v[:, None] & draw[None, :]) % 2 == 1
            chance = (0.5 ** odd.sum(1)).sum()
            if chance < least:
                best, least = odd, chance
        for row in best:
            mask = np.zeros(2, np.uint64)
            for b in bits[lo:hi][row]:
                mask[b // 64] |= np.uint64(1) << np.uint64(b % 64)
            out.append(mask)
    return np.array(out)


def plan(n: int) -> np.ndarray:
    """The masks of the tables for n codes."""
    for family in FAMILIES:
        masks = covering(family)
        if n * np.mean(0.5 ** np.bitwise_count(masks).sum(1, dtype=np.int64)) <= SHARD:
            break
    return masks


def keys(code: np.ndarray, masks: np.ndarray, t: int | np.ndarray) -> np.ndarray:
    """Shard keys of codes in table t, or in a table each."""
    m = masks[t]
    return mix(mix((code[:, 0] & m[..., 0]) + np.asarray(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (code[:, 1] & m[..., 1]))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The code of every row, null where it takes no part."""
    for b in slices(batches):
        code, n = codes(b.column("text"))
        out = b.column("doc_id").is_null().to_numpy(zero_copy_only=False) | (n == 0)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "hi": pa.array(code[:, 0].view(np.int64), mask=out), "lo": pa.array(code[:, 1].view(np.int64), mask=out)})


def _code(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("hi", "lo")], 1)


def _heavy(batches: Iterator[pa.RecordBatch], masks: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Keys that have their share of HOT, by the rows of this partition, and how many rows have them."""
    held = [_code(b) for b in batches]
    if not held:
        return
    code = np.concatenate(held)
    least = max(1, HOT * len(code) / n)
    for t in range(len(masks)):
        k, count = np.unique(keys(code, masks, t), return_counts=True)
        k, count = k[count >= least], count[count >= least]
        yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "n": pa.array(count)})


def hot_shards(distinct: DataFrame, masks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, blocks) of shards with more than HOT codes, keys ascending, of at most HOT_SHARDS. A shard with more than twice as many is
    among them; the cut into blocks is for evenness only, so that one left out is slower, not lost."""
    if n <= HOT:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = distinct.select("hi", "lo").mapInArrow(lambda it: _heavy(it, masks, n), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    got = count.where(F.col("n") > HOT).orderBy(F.desc("n"), "key").limit(HOT_SHARDS).toArrow()
    key = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], np.minimum(1 + got.column("n").to_numpy()[order] // HOT, 1 << 15)


#: Columns of an entry, besides the code: its table, the number of its rep, and what says of which pair of blocks it is part.
PLANES = (np.dtype("<u2"), np.dtype("<u8"), np.dtype("<u8"), np.dtype("<i8"), np.dtype("<u4"))


def _shards(batches: Iterator[pa.RecordBatch], masks: np.ndarray, parts: int, hot: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each of a batch's codes and target group: all entries that go there."""
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            b = whole.slice(at, 20_000)
            code, rep = _code(b), b.column("rep").to_numpy()
            t = np.repeat(np.arange(len(masks)), len(code)).astype(np.uint16)
            row = np.tile(np.arange(len(code)), len(masks))
            key = np.concatenate([keys(code, masks, k) for k in range(len(masks))])
            pair = np.zeros(len(key), np.uint32)
            if len(hot[0]):
                found = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1)
                is_hot = hot[0][found] == key
                cold, warm = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
                blocks = hot[1][found[warm]]
                own = np.repeat((mix(code[row[warm], 0] ^ mix(code[row[warm], 1])) % blocks.astype(np.uint64)).astype(np.int64), blocks)
                other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                many = np.concatenate([cold, np.repeat(warm, blocks)])
                # a pair of blocks (a, b), a <= b, and the side: which of them the code is of; at most 2 ** 15 blocks
                both = 2 * ((np.minimum(own, other) << 15) + np.maximum(own, other)) + (own > other)
                pair = np.concatenate([np.zeros(len(cold), np.int64), both]).astype(np.uint32)
                t, row, key = t[many], row[many], key[many]
            part = (mix(key + (pair >> np.uint32(1)).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            columns = [c[order] for c in (t, code[row, 0], code[row, 1], rep[row], pair)]
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            data = [b"".join(c[cuts[p] : cuts[p + 1]].astype(k).tobytes() for c, k in zip(columns, PLANES)) for p in some]
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int64()), "rows": pa.array(data, pa.binary())})


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (of every node, the least known node of its component) after the edges a, b."""
    while True:
        x, y = labels[a], labels[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return labels
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _entries(group: pa.Table) -> list[np.ndarray]:
    """The columns of a group's entries."""
    size = sum(k.itemsize for k in PLANES)
    held: list[list[np.ndarray]] = [[] for _ in PLANES]
    for chunk in group.column("rows").chunks:
        for v in chunk:
            data = v.as_buffer()
            n, at = len(data) // size, 0
            for k, column in zip(PLANES, held):
                column.append(np.frombuffer(data, k, n, at))
                at += n * k.itemsize
    return [np.concatenate(c) for c in held]


def _first(x: np.ndarray, t: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Of differences x in tables t that miss them, which no earlier table misses."""
    out = np.ones(len(t), bool)
    left = np.flatnonzero(t > 0)
    for k in range(len(masks)):
        if not len(left):
            break
        missed = ((x[left, 0] & masks[k, 0]) | (x[left, 1] & masks[k, 1])) == 0
        out[left[missed]] = False
        left = left[~missed & (t[left] > k + 1)]
    return out


def _found(group: pa.Table, masks: np.ndarray) -> pa.Table:
    """What connects the near codes of a group's trees, as a link (a, b) from the least rep of each component to every other, so that a
    large group has as many links as members, however many pairs are near; and (a, null, n): how many near codes rep a has by
    pairs that no earlier table has."""
    t, hi, lo, rep, pair = _entries(group)
    code = np.stack([hi, lo], 1)
    key = keys(code, masks, t.astype(np.int64))
    block = pair >> np.uint32(1)
    order = np.lexsort((block, key)) if pair.any() else np.argsort(key)  # the table is in the key
    t, code, rep, pair, key, block = (c[order] for c in (t, code, rep, pair, key, block))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    crossed = (block >> np.uint32(15)) != (block & np.uint32((1 << 15) - 1))  # of two different blocks
    forest = Forest(code, np.cumsum(new), masks[t, 0])
    ids, node = np.unique(rep, return_inverse=True)
    labels, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for q, k, _ in forest.near(RADIUS):
        real = ~crossed[q] | (pair[q] != pair[k])
        q, k = q[real], k[real]
        one = _first(code[q] ^ code[k], t[q], masks)  # in some group each near pair is
        q, k = node[q[one]], node[k[one]]
        labels = join_labels(labels, q, k)
        links += np.bincount(q, minlength=len(ids)) + np.bincount(k, minlength=len(ids))
    del forest, code, key, block, order, t, hi, lo, rep, pair
    trim()
    other, some = np.flatnonzero(labels != np.arange(len(ids))), np.flatnonzero(links)
    a = np.concatenate([ids[labels[other]], ids[some]])
    b = pa.array(np.concatenate([ids[other], ids[some]]), mask=np.arange(len(a)) >= len(other))
    return pa.table({"a": a, "b": b, "n": np.concatenate([np.zeros(len(other), np.int64), links[some]])})


LINKS = "a bigint, b bigint, n bigint"


def find_links(distinct: DataFrame, n: int) -> DataFrame:
    """Of n different codes (hi, lo, rep): links (a, b) enough to connect what is near, and rows (a, null, n), whose sum is the number of
    codes near to that of rep a."""
    masks = plan(n)
    hot = hot_shards(distinct, masks, n)
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(masks) / ENTRIES))
    sent = distinct.select("hi", "lo", "rep").mapInArrow(lambda it: _shards(it, masks, parts, hot), "part bigint, rows binary")
    return sent.groupBy("part").applyInArrow(lambda g: _found(g, masks), LINKS)


def components(links: DataFrame) -> Table:
    """(node, root) for every a and b of links (a < b): root is the smallest id of the component. Large-star and small-star
    steps, each of which is written, until nothing changes."""
    edges = table(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = both.join(low, "u")
        if large:
            return near.where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where(F.col("u") != F.col("v")).distinct()
        return near.select(F.col("m").alias("u"), "v").unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).where(F.col("u") != F.col("v")).distinct()

    count = lambda t: tuple(t.df.agg(F.count("*"), F.sum(F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).cast("decimal(38,0)"))).first())
    before = count(edges)
    while True:
        step = table(star(star(edges.df, True), False), "edges")
        edges.drop()
        edges, after = step, count(step)
        if after == before:
            break
        before = after
    out = table(edges.df.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")), "roots")
    edges.drop()
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of docs: doc_id, keep_id (the smallest id of its group), links (how many other codes are near to its own), copies
    (rows with the same code) and is_copy (keep_id is another id).

    A row without an id, a text or a word is in no group: keep_id is its own id, links 0, copies 1. Repeated rows count as
    copies of each other and have the same row here. Rows of one id with different texts join the groups of these texts.
    Other columns are not read, no rows give no rows."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    coded = table(d.mapInArrow(_coded, "doc_id bigint, hi bigint, lo bigint"), "codes")
    real = coded.df.where(F.col("hi").isNotNull())
    distinct = table(real.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    found = table(find_links(distinct.df, distinct.df.count()), "links")
    # ids with several codes, each of which is linked to the least of them
    several = real.groupBy("doc_id").agg((F.min(F.struct("hi", "lo")) != F.max(F.struct("hi", "lo"))).alias("several")).where("several").select("doc_id")
    reps = real.join(several, "doc_id").select("doc_id", "hi", "lo").distinct().join(distinct.df, ["hi", "lo"]).select("doc_id", "rep")
    same = reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b"))
    roots = components(found.df.where(F.col("b").isNotNull()).select("a", "b").unionByName(same).distinct())
    count = found.df.where(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    stats = distinct.df.join(count, "rep", "left").join(roots.df.withColumnRenamed("node", "rep"), "rep", "left")
    stats = stats.select("hi", "lo", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "copies").where("links > 0 OR copies > 1 OR root != rep")
    marks = table(stats, "marks")
    for t in (distinct, found, roots):
        t.drop()
    keep = F.coalesce("root", "doc_id")
    is_copy = F.coalesce(keep != F.col("doc_id"), F.lit(False)).alias("is_copy")
    return coded.df.join(marks.df, ["hi", "lo"], "left").select("doc_id", keep.alias("keep_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), is_copy)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id is in a group of near copies and isn't the group's smallest; all columns stay.

    Rows that are in no group stay; repeated rows stay or go together."""
    (name,) = free(docs, "gone")
    gone = near_groups(docs, id_col, text_col).where("is_copy").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
