"""Toxicity (3): a factorization machine over hashed terms.

score(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j over the terms present in a text, so a pair of terms can count
for more, or less, than the two alone. Terms are words of the lower-cased text, hashed to 44 bits. The model is fitted by one
task to a bounded sample of labelled rows (TRAIN_ROWS); it is a few thousand terms and goes to the executors whole.

A term takes part if it tells something of toxicity alone, or if a pair with it does: among the texts that hold a term which is at
least somewhat frequent in toxic texts, all others are tried. A group's name that is toxic next to an insult only is found so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import free
from .textops import Words, slices, trim, unique_terms

#: At most so many labelled documents are fitted to; which, is decided by a hash of their id.
TRAIN_ROWS = 20_000
FACTORS = 4
EPOCHS = 100
RATE = 0.5  # AdaGrad's, of the linear weights
#: A term takes part if its share of toxic documents is so many standard errors from the rate of all.
TERM_Z = 3.5
MIN_DOCS = 3
#: Or if texts that hold it and a head (a term of HEAD_Z at least, and HEAD_LIFT times as toxic as all) are PAIR_Z beyond the rates of either, and so is that one then: there are
#: far more pairs than terms, so chance must be ruled out more firmly; in PAIR_DOCS texts at least, PAIR_MORE toxic ones of them beyond.
HEAD_Z = 2.0
HEAD_LIFT = 1.5
PAIR_Z = 8.0
PAIR_DOCS = 6
PAIR_MORE = 4
#: Cells of a table of pairs that are counted at once.
PAIR_CELLS = 1 << 21
BITMAP_BITS = 20


@dataclass(frozen=True)
class FactorizationMachine:
    terms: np.ndarray  # ascending, uint64
    w0: float
    w: np.ndarray
    v: np.ndarray  # terms x FACTORS
    threshold: float

    def score(self, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
        """Of rows texts, where (row, at) says which of the model's terms each contains."""
        out = np.full(rows, self.w0)
        out += np.bincount(row, self.w[at], rows)
        for f in range(self.v.shape[1]):
            v = self.v[at, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out


def partners(row: np.ndarray, at: np.ndarray, toxic: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which terms tell of toxicity in a pair with a head (a mask of terms), more toxic than the texts of either, and these heads. (row, at): by row."""
    n_terms = len(heads)
    out = np.zeros(n_terms, bool)
    first = np.searchsorted(row, np.arange(len(toxic) + 1))
    rate = np.bincount(at, toxic[row], n_terms) / np.maximum(np.bincount(at, minlength=n_terms), 1)
    heads = np.flatnonzero(heads)
    step = max(1, PAIR_CELLS // max(1, n_terms))
    place = np.full(n_terms, -1)
    for some in (heads[k : k + step] for k in range(0, len(heads), step)):
        place[some] = np.arange(len(some))
        hold = np.flatnonzero(place[at] >= 0)  # (text, head) pairs, each with all terms of the text
        n, hit = np.zeros(len(some) * n_terms, np.int32), np.zeros(len(some) * n_terms, np.int32)
        size = first[row[hold] + 1] - first[row[hold]]
        ends = np.cumsum(size)
        a = 0
        while a < len(hold):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIR_CELLS, "right")))
            h, k = hold[a:z], size[a:z]
            term = at[np.repeat(first[row[h]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            cell = np.repeat(place[at[h]], k) * n_terms + term
            n += np.bincount(cell, minlength=len(n)).astype(np.int32)
            hit += np.bincount(cell[np.repeat(toxic[row[h]], k)], minlength=len(n)).astype(np.int32)
            a = z
        n, hit = n.reshape(len(some), n_terms), hit.reshape(len(some), n_terms)
        for j, head in enumerate(some):
            often = np.flatnonzero(n[j] >= PAIR_DOCS)
            both, toxic_both = n[j, often], hit[j, often]
            high = np.maximum(rate[often], rate[head])
            more = toxic_both - both * high
            told = often[(more >= PAIR_MORE) & (more >= PAIR_Z * np.sqrt(both * high * (1 - high)))]
            out[told] = True
            out[head] |= len(told) > 0
        place[some] = -1
    return out


def fit(row: np.ndarray, term: np.ndarray, toxic: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """To texts 0..len(toxic), whose distinct terms are (row, term). With no rows, or one class only, nothing is toxic."""
    rows = len(toxic)
    none = FactorizationMachine(np.zeros(0, np.uint64), -10.0, np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    if not rows or toxic.all() or not toxic.any():
        return none
    terms = np.sort(term)
    new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1], [True]]))
    terms = terms[new[:-1][np.diff(new) >= MIN_DOCS]]  # of the others none can take part
    if not len(terms):
        return none
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1).astype(np.int32)
    known = terms[at] == term
    row, at = row[known], at[known]
    if (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, at = row[order], at[order]
    n, hit = np.bincount(at), np.bincount(at, toxic[row])
    rate = toxic.mean()
    z = (hit - n * rate) / np.sqrt(n * rate * (1 - rate))
    keep = np.abs(z) >= TERM_Z
    often = (n >= PAIR_DOCS) & (hit >= PAIR_MORE)  # others are in no pair that tells
    use = often[at]
    keep[np.flatnonzero(often)[partners(row[use], (np.cumsum(often) - 1)[at[use]], toxic, ((z >= HEAD_Z) & (hit >= HEAD_LIFT * rate * n))[often])]] = True
    if not keep.any():
        return none
    place = np.cumsum(keep) - 1
    use = keep[at]
    row, at, terms = row[use], place[at[use]], terms[keep]
    rng = np.random.RandomState(seed)
    held = rng.rand(rows) < 0.2
    p = len(terms)
    w0, w, v = float(np.log(rate / (1 - rate))), np.zeros(p), rng.normal(0, 0.05, (p, FACTORS))
    gw0, gw, gv = 1e-6, np.full(p, 1e-6), np.full((p, FACTORS), 1e-6)
    first = np.searchsorted(row, np.arange(rows + 1))
    train = np.flatnonzero(~held)
    weight = np.where(toxic, 0.5 / rate, 0.5 / (1 - rate))
    for epoch in range(EPOCHS):
        rng.shuffle(train)
        for k in range(0, len(train), 256):
            batch = train[k : k + 256]
            size = first[batch + 1] - first[batch]
            r = np.repeat(np.arange(len(batch)), size)
            pick = np.repeat(first[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())
            a = at[pick]
            va = v[a]
            sums = np.zeros((len(batch), FACTORS))
            for f in range(FACTORS):
                sums[:, f] = np.bincount(r, va[:, f], len(batch))
            s = w0 + np.bincount(r, w[a], len(batch)) + 0.5 * ((sums**2).sum(1) - np.bincount(r, (va**2).sum(1), len(batch)))
            g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - toxic[batch]) * weight[batch] / len(batch)
            dw = np.bincount(a, g[r], p) + 1e-5 * w
            gw += dw**2
            w -= RATE * dw / np.sqrt(gw)
            for f in range(FACTORS):
                dv = np.bincount(a, g[r] * (sums[r, f] - va[:, f]), p) + 1e-4 * v[:, f]
                gv[:, f] += dv**2
                v[:, f] -= 0.05 * dv / np.sqrt(gv[:, f])
            d0 = g.sum()
            gw0 += d0 * d0
            w0 -= RATE * d0 / gw0**0.5
    model = FactorizationMachine(terms, w0, w, v, 0.0)
    check = held if toxic[held].any() and not toxic[held].all() else np.ones(rows, bool)
    s = model.score(row, at, rows)[check]
    order = np.argsort(-s, kind="stable")
    hits = np.cumsum(toxic[check][order])
    precision, recall = hits / np.arange(1, len(hits) + 1), hits / hits[-1]
    f = 1.25 * precision * recall / np.maximum(0.25 * precision + recall, 1e-12)  # F0.5: a clean text lost costs more
    last = np.append(s[order][1:] < s[order][:-1], True)  # a threshold can't part equal scores
    best = int(np.argmax(np.where(last, f, -1)))
    below = s[order][best + 1] if best + 1 < len(s) else s[order][best] - 1
    return FactorizationMachine(terms, w0, w, v, float((s[order][best] + below) / 2))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        words = Words(b.column("text"))
        doc, term = unique_terms(words.doc, words.hash)
        offsets = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "toxic": b.column("toxic"), "terms": pa.ListArray.from_arrays(pa.array(offsets), pa.array(term.view(np.int64)))})


MODEL = "terms array<bigint>, w0 double, w array<double>, v array<double>, threshold double"


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the sample, as one row."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    group = pa.Table.from_batches(held).sort_by("doc_id")
    terms = group.column("terms").combine_chunks()
    flat, size = terms.flatten().to_numpy().view(np.uint64), np.diff(terms.offsets.to_numpy())
    m = fit(np.repeat(np.arange(len(size), dtype=np.int32), size), flat, group.column("toxic").to_numpy(zero_copy_only=False).astype(bool))
    del held, group, terms, flat
    trim()
    many = lambda x, t: pa.array([x.tolist()], pa.list_(t))
    yield pa.RecordBatch.from_pydict({"terms": many(m.terms.view(np.int64), pa.int64()), "w0": [m.w0], "w": many(m.w, pa.float64()), "v": many(m.v.ravel(), pa.float64()), "threshold": [m.threshold]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """On at most `rows` labelled ids of docs (doc_id, text) and labels (doc_id, toxic 0/1), by one task. Rows without a label, a
    text or an id don't count; an id labelled more than once is toxic if any of its labels says so, and one of several texts
    counts with the first of them in byte order."""
    key = F.col("doc_id").cast("bigint").alias("doc_id")
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(key).agg((F.max("toxic") > 0).alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.where(F.col("text").isNotNull()).select(key, "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = texts.mapInArrow(_terms, "doc_id bigint, toxic boolean, terms array<bigint>").repartition(1).mapInArrow(_fitted, MODEL).first()
    if got is None:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    return FactorizationMachine(np.array(got.terms, np.int64).view(np.uint64), got.w0, np.array(got.w), np.array(got.v).reshape(-1, FACTORS), got.threshold)


class Scorer:
    """Scores of many texts. A bitmap over the upper bits of the model's terms spares most words the search."""

    def __init__(self, model: FactorizationMachine):
        self.model = model
        self.shift = np.uint64(64 - BITMAP_BITS)
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[model.terms << np.uint64(20) >> self.shift] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words, m = Words(texts), self.model
        if not len(m.terms):
            return np.full(words.rows, m.w0)
        near = self.bitmap[words.hash >> self.shift]
        doc, term = unique_terms(words.doc[near], words.hash[near])
        at = np.searchsorted(m.terms, term)
        at[at == len(m.terms)] = 0
        real = m.terms[at] == term
        return m.score(doc[real], at[real], words.rows)


def with_score(docs: DataFrame, model: FactorizationMachine, name: str, text_col: str = "text") -> DataFrame:
    """docs with the model's score of each text as column `name`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept: dict[str, Scorer] = {}

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = kept.setdefault("scorer", Scorer(sent.value))
        for s in texts:
            batch = pa.RecordBatch.from_pydict({"text": pa.array(s, pa.large_string(), from_pandas=True)})
            got = [scorer(b.column("text")) for b in slices(iter([batch]))]
            yield pd.Series(np.concatenate(got) if got else np.zeros(0))

    return docs.withColumn(name, score(F.col(text_col)))


def _scored(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(sent.value)
    for b in slices(batches):
        s = scorer(b.column("text"))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(s), "toxic": pa.array(s > sent.value.threshold)})


def find_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """For every row of docs: doc_id, score (the machine's log-odds) and toxic (score above the threshold learned).

    A null or empty text holds no term; its score is the machine's bias and it isn't toxic. Repeated rows are scored each
    for itself, a null id stays null, other columns are not read, no rows give no rows. Without labels of both kinds
    nothing is toxic."""
    model = train(docs, labels, rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _scored(it, sent), "doc_id bigint, score double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs without the rows that find_toxic calls toxic; all columns stay, whatever their names."""
    model = train(docs, labels, rows)
    (name,) = free(docs, "score")
    return with_score(docs, model, name).where(F.col(name) <= model.threshold).select(docs.columns)
