"""Language ID (4): nearest centroid over TF-IDF vectors of character n-grams.

A text is the vector of its byte trigrams and bigrams (of the lower-cased text), hashed to BUCKETS, log-scaled, weighted by
inverse document frequency over all of the corpus and normalised. Every language has several centroids, found by k-means over
all of its rows, of which some are the start only; a text gets the language of the centroid nearest by cosine, or none (null) if even that one is
farther than the radius learned, from all rows, for its language and for texts of that length: short texts of a language are farther from
its centroids than long ones, so one radius for all would be too wide for long texts or too narrow for short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import buffers, slices

BUCKETS = 4096
#: Labelled rows of each language, chosen by a hash, that k-means starts from; ROUNDS over all labelled rows follow.
START_ROWS = 1500
ROUNDS = 3
CENTROIDS = 3
#: A text is rejected if its distance from the nearest centroid exceeds that of this part of the language's rows,
#: each cut to the largest of SIZES (in characters) that the text has. A few junk rows don't widen it.
QUANTILE = 0.99
SIZES = np.array([4 << k for k in range(9)])
#: Distances are counted in steps of one part of so many, rounded up.
STEPS = 1 << 16
#: For rounding.
SLACK = 1e-6
_SALT = np.random.RandomState(11).randint(0, 2**32, (3, 256), dtype=np.int64).astype(np.uint32)


def _bucket(raw: np.ndarray, k: int) -> np.ndarray:
    """Of the k bytes that begin at each place."""
    m = len(raw) - k + 1
    h = _SALT[0][raw[:m]]
    for j in range(1, k):
        h ^= np.multiply(_SALT[j][raw[j : m + j]], np.uint32(2 * k + 1))
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(20)


def counts(texts: pa.Array) -> np.ndarray:
    """rows x BUCKETS: how often each bucket's n-grams occur; n-grams of bytes, within one text."""
    raw, offsets = buffers(pc.utf8_lower(texts))
    rows, n = len(offsets) - 1, len(raw)
    out = np.zeros(rows * BUCKETS, np.float32)
    if n:
        doc = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets)) * np.int32(BUCKETS)
        end = np.repeat(offsets[1:], np.diff(offsets))
        for k in (2, 3):
            if n < k:
                break
            inside = np.arange(n - k + 1) + k <= end[: n - k + 1]
            out += np.bincount((doc[: n - k + 1] + _bucket(raw, k).astype(np.int32))[inside], minlength=len(out)).astype(np.float32)
    return out.reshape(rows, BUCKETS)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts))
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of few rows too: a row is BUCKETS numbers."""
    for b in slices(batches):
        for at in range(0, b.num_rows, 512):
            yield b.slice(at, 512)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in _parts(batches):
        seen = counts(b.column("text")) > 0
        df += seen.sum(0)
        n += int(seen.any(1).sum())
    if n:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), "n": pa.array(np.concatenate([[n], df]))})


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """idf by bucket, from all of docs' texts; each partition sends one sum per bucket."""
    got = docs.select("text").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    by = {r.bucket: r.n for r in got}
    return np.array([np.log((1 + by.get(-1, 0)) / (1 + by.get(k, 0))) + 1 for k in range(BUCKETS)], np.float32)


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    languages: tuple[str, ...]  # of each centroid
    centres: np.ndarray
    radius: np.ndarray  # by centroid and size, as a distance 1 - cosine

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest centroid, its cosine, whether it is near enough)."""
        rows = len(texts)
        if not self.languages:
            return np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows, bool)
        x = vectors(texts, self.idf)
        cosine = x @ self.centres.T
        best = np.argmax(cosine, axis=1)
        c = cosine[np.arange(rows), best].astype(np.float64)
        chars = pc.utf8_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False)
        size = np.maximum(np.searchsorted(SIZES, chars, "right") - 1, 0)
        return best, c, (1 - c <= self.radius[best, size] + SLACK) & x.any(axis=1)


def _kmeans(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means; fewer centroids than k if there are fewer distinct rows."""
    rng = np.random.RandomState(seed)
    pick = [rng.randint(len(x))]
    for _ in range(k - 1):
        far = 1 - (x @ x[pick].T).max(1)
        if far.max() < 1e-6:
            break
        pick.append(int(rng.choice(len(x), p=np.maximum(far, 0) / np.maximum(far, 0).sum())))
    c = x[pick]
    for _ in range(15):
        at = np.argmax(x @ c.T, 1)
        c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _weights(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight before normalisation) of what isn't 0 in the texts' vectors, by row: cheaper than vectors for short texts."""
    raw, offsets = buffers(pc.utf8_lower(texts))
    n = len(raw)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = np.repeat(offsets[1:], np.diff(offsets))
    keys = [np.zeros(0, np.int64)]
    for k in (2, 3):
        if n >= k:
            inside = np.arange(n - k + 1) + k <= end[: n - k + 1]
            keys.append((doc[: n - k + 1] * BUCKETS + _bucket(raw, k))[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // BUCKETS, key % BUCKETS, np.log1p(count.astype(np.float32)) * idf[key % BUCKETS]


@dataclass(frozen=True)
class _Model:
    idf: np.ndarray
    languages: tuple[str, ...]
    centres: np.ndarray  # languages x CENTROIDS x BUCKETS; where a language has fewer, the first again


def _labelled(batches: Iterator[pa.RecordBatch], model: _Model) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(texts, place of the language) of rows whose language has centroids."""
    place = pa.array(model.languages, pa.string())
    for b in _parts(batches):
        lang = pc.index_in(b.column("lang"), value_set=place)
        known = pc.is_valid(lang)
        if pc.any(known).as_py():
            yield b.column("text").filter(known), lang.filter(known).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors nearest to each centroid of their own language."""
    model = sent.value
    total = np.zeros(model.centres.shape)
    for texts, lang in _labelled(batches, model):
        x = vectors(texts, model.idf)
        for k in np.unique(lang):
            own = x[lang == k]
            at = np.argmax(own @ model.centres[k].T, 1)
            for j in range(CENTROIDS):
                total[k, j] += own[at == j].sum(0)
    flat = total.ravel()
    some = np.flatnonzero(flat)
    yield pa.RecordBatch.from_pydict({"at": pa.array(some), "x": pa.array(flat[some])})


def _distances(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """How many rows of a language, cut to a size, have a distance of so many steps; size -1: whole texts shorter than the first."""
    model = sent.value
    counted: dict[int, int] = {}
    for texts, lang in _labelled(batches, model):
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        for k, size in enumerate((int(SIZES[0]), *SIZES.tolist()), -1):
            rows = np.flatnonzero(chars >= size if k >= 0 else chars < size)
            if not len(rows):
                continue
            row, bucket, w = _weights(pc.utf8_slice_codeunits(texts.take(pa.array(rows)), 0, size), model.idf)
            norm = np.sqrt(np.bincount(row, w * w, len(rows)))
            own = lang[rows]
            dot = np.max([np.bincount(row, w * model.centres[own[row], j, bucket], len(rows)) for j in range(CENTROIDS)], axis=0)
            some = norm > 0
            step = np.ceil(np.clip(1 - dot[some] / norm[some], 0, 1) * STEPS).astype(np.int64)
            key, n = np.unique((own[some] * (len(SIZES) + 1) + k + 1) * (STEPS + 1) + step, return_counts=True)
            for i, c in zip(key.tolist(), n.tolist()):
                counted[i] = counted.get(i, 0) + c
    key = np.array(list(counted), np.int64)
    yield pa.RecordBatch.from_pydict({"at": pa.array(key // (STEPS + 1)), "step": pa.array(key % (STEPS + 1)), "n": pa.array(np.array(list(counted.values()), np.int64))})


def _start(group: pa.Table, idf: np.ndarray) -> pa.Table:
    """The centroids that a language starts with, on an executor."""
    group = group.sort_by([("draw", "ascending"), ("text", "ascending")])
    x = np.concatenate([vectors(b.column("text"), idf) for b in _parts(iter(group.to_batches()))])
    x = x[x.any(1)]
    c = _kmeans(x, CENTROIDS) if len(x) else []
    return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(c), pa.string()), "centre": pa.array(list(c), pa.list_(pa.float32()))})


def train(docs: DataFrame) -> Centroids:
    """On all rows of docs (doc_id, text, lang) with a text and a language; idf on all with a text."""
    context = docs.sparkSession.sparkContext
    idf = document_frequencies(docs)
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    drawn = labelled.where(F.length("text") > 1).withColumn("draw", F.xxhash64("doc_id", "text"))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("rank") <= START_ROWS).drop("rank")
    got = drawn.groupBy("lang").applyInArrow(lambda t: _start(t, idf), "lang string, centre array<float>").toArrow().to_pylist()
    by: dict[str, list] = {}
    for r in got:
        by.setdefault(r["lang"], []).append(r["centre"])
    if not by:
        return Centroids(idf, (), np.zeros((0, BUCKETS)), np.zeros((0, len(SIZES))))
    languages = tuple(sorted(by))
    number = [len(by[k]) for k in languages]
    centres = np.array([by[k] + by[k][:1] * (CENTROIDS - len(by[k])) for k in languages], np.float32)
    for _ in range(ROUNDS):
        sent = context.broadcast(_Model(idf, languages, centres))
        sums = labelled.mapInArrow(lambda it, sent=sent: _sums(it, sent), "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros(centres.size)
        total[sums.column("at").to_numpy()] = sums.column("x").to_numpy()
        total = total.reshape(centres.shape)
        length = np.linalg.norm(total, axis=2, keepdims=True)
        centres = np.where(length > 0, total / np.maximum(length, 1e-12), centres).astype(np.float32)
        for k, n in enumerate(number):
            centres[k, n:] = centres[k, 0]
    sent = context.broadcast(_Model(idf, languages, centres))
    steps = labelled.mapInArrow(lambda it: _distances(it, sent), "at bigint, step bigint, n bigint").groupBy("at", "step").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("at")
    steps = steps.select("at", "step", F.sum("n").over(w.orderBy("step")).alias("upto"), F.sum("n").over(w).alias("all"))
    least = {r["at"]: r["step"] / STEPS for r in steps.where(F.col("upto") >= F.col("all") * QUANTILE).groupBy("at").agg(F.min("step").alias("step")).collect()}
    radius = []
    for k in range(len(languages)):
        own = []  # where no text is so long, the radius of the size before
        for size in range(len(SIZES) + 1):
            own.append(least.get(k * (len(SIZES) + 1) + size, own[-1] if own else 0.0))
        radius.append(own[1:])
    return Centroids(idf, tuple(x for x, n in zip(languages, number) for _ in range(n)), np.concatenate([c[:n] for c, n in zip(centres, number)]), np.repeat(np.array(radius), number, 0))


def _identified(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    for b in _parts(batches):
        best, cosine, near = model.predict(b.column("text"))
        lang = [model.languages[k] if ok else None for k, ok in zip(best, near)]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "language": pa.array(lang, pa.string()), "cosine": pa.array(cosine), "rejected": pa.array(~near)})


def identify(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, language (null if rejected), cosine with the nearest centroid, rejected.

    A null or empty text, and one of a single byte, has no n-gram and is rejected with cosine 0. Repeated rows are judged
    each for itself, a null id stays null, columns other than doc_id, text and lang are not read, no rows give no rows.
    Without a labelled row every text is rejected. Of centroids equally near the first by language counts."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _identified(it, sent), "doc_id bigint, language string, cosine double, rejected boolean")
