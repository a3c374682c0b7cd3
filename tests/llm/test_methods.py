"""The ten operators against brute force, exact round trips and held-out accuracy."""

import html
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from fathom.llm import bpe, exact, fingerprints, language, licences, packing, queries, simhash, suffix, textops, toxicity, wrappers

SF = "/root/testdata/sf0.001"
TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=60)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- words


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_words(texts):
    w = textops.Words(pa.array(texts), "ascii")
    got = [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in re.findall("[a-zA-Z0-9\x80-\U0010ffff]+", t)]
    by = defaultdict(set)
    for x, h in zip(got, w.hash):
        by["".join(c.lower() if c < "\x80" else c for c in x)].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


# --- 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\nß\U0001f642", max_size=30), min_size=2, max_size=4), st.data())
def test_prefix_hashes(texts, data):
    h = fingerprints.PrefixHashes(pa.array(texts))
    i, j = (data.draw(st.integers(0, len(texts) - 1)) for _ in range(2))
    a, b = data.draw(st.integers(0, len(texts[i]))), data.draw(st.integers(0, len(texts[j])))
    x, y = texts[i][a:], texts[j][b:]
    common = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    one = lambda v: np.array([v])
    assert h.extension(one(h.first[i] + a), one(h.first[j] + b), one(min(len(x), len(y))))[0] == common
    x, y = texts[i][:a][::-1], texts[j][:b][::-1]
    common = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert h.extension(one(h.first[i] + a), one(h.first[j] + b), one(min(a, b)), back=True)[0] == common
    for k, t in enumerate(texts):
        for p, v in zip(fingerprints.PRIMES, h.hashes(h.first[k : k + 1], h.first[k + 1 : k + 2])):
            assert v[0] == sum(ord(c) * pow(fingerprints.BASE, n, p) for n, c in enumerate(t)) % p


def test_extensions(spark, docs, rows):
    pairs = spark.createDataFrame([(a, b) for a, _ in rows[:12] for b, _ in rows[5:9]], "left_id bigint, right_id bigint")
    text = dict(rows)

    def common(x, y):
        return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    for r in fingerprints.extensions(docs, pairs).collect():
        x, y = text[r.left_id], text[r.right_id]
        assert (r.prefix, r.suffix) == (common(x, y), common(x[::-1], y[::-1]))


# --- 2


def test_bpe_against_the_rank_encoder(rows):
    import tiktoken

    pieces = bpe.read_ranks(bpe.VOCABULARY)
    ours = bpe.Tokenizer(bpe.serialise(pieces))
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={x: k for k, x in enumerate(pieces)}, special_tokens={})
    more = ["", " ", "a▁b\x00\x01  \n\n ", "日本語\U0001f642" * 30, " " * 3000 + "x" * 2000, "it's 'll 123 ?!\t"]
    for text in [t for _, t in rows] + more:
        ids = ours.encode(text)
        assert ids == other.encode_ordinary(text) and ours.decode(ids) == text


@settings(max_examples=80, deadline=None)
@given(TEXT)
def test_bpe_round_trip(text):
    global _OURS
    try:
        ours = _OURS
    except NameError:
        ours = _OURS = bpe.Tokenizer(bpe.serialise(bpe.read_ranks(bpe.VOCABULARY)))
    assert ours.decode(ours.encode(text)) == text


def test_bpe_query(spark, docs, rows):
    got = queries.op2_byte_bpe(spark, SF)
    assert all(r.round_trip and r.tokens == len(r.ids) for r in got.collect())
    assert {r.doc_id: r.text for r in bpe.decode(got).collect()} == dict(rows)


def test_counts_are_those_of_ids_and_look_at_each_word_once(monkeypatch):
    model, seen, init = bpe.serialise(bpe.read_ranks(bpe.VOCABULARY)), [], bpe.Tokenizer.__init__

    def watched(self, *a):
        init(self, *a)
        split = self.split
        self.split = lambda t: (seen.append(len(t)), split(t))[1]

    def counts(texts):
        b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "h": pa.array(range(len(texts)), pa.int64())})
        return [n for x in bpe._counted(iter([b]), type("Sent", (), {"value": model})) for n in x.column("n").to_pylist()]

    monkeypatch.setattr(bpe.Tokenizer, "__init__", watched)
    r = random.Random(5)
    texts = [None, "", " ", "a ", " a", "a  b", "a \nb", "a\n b", "a\n\n b\n", "x" * 100 + " " + "y" * 100, "it's 'll"]
    texts += ["".join(r.choice("ab'sté1½_. \n\t\x1c\x85\u3000漢\U0001f642," + "  a" * 4) for _ in range(r.randrange(14))) for _ in range(5000)]
    assert counts(texts) == [len(x) for x in bpe.Tokenizer(model).encode_all([t or "" for t in texts])]
    seen.clear()
    assert counts(["one two three. " * 1000 + "end"] * 20) == [4001] * 20 and sum(seen) < 1000


# --- 3


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 3 <> 0"), {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r.toxic for r in toxicity.find_toxic(d, train).collect() if r.doc_id in held}
    hit = sum(got[i] and held[i] for i in held)
    assert hit / sum(got.values()) > 0.93 and hit / sum(held.values()) > 0.75


def test_interactions_are_learned():
    """Toxic exactly if both of two terms are there: no linear weights can tell, pairs can."""
    r = np.random.RandomState(1)
    x = r.rand(4000, 2) < 0.5
    toxic = x.sum(1) == 2
    noise = r.randint(100, 130, (4000, 3)).astype(np.uint64)
    terms = [(i, t) for i in range(4000) for t in ([1] * int(x[i, 0]) + [2] * int(x[i, 1]) + noise[i].tolist())]
    row, term = (np.array(c, np.uint64) for c in zip(*terms))
    m = toxicity.fit(row.astype(np.int64), term, toxic)
    at = lambda ts: m.score(np.zeros(len(ts), np.int64), np.searchsorted(m.terms, np.array(ts, np.uint64)), 1)[0] > m.threshold
    assert at([1, 2]) and not at([1]) and not at([2])


@pytest.mark.parametrize("share, group", [(0.01, 0.1), (0.02, 0.05)])
def test_rare_pairs_are_learned(share, group):
    """An insult in 1 or 2 % and a group in 10 or 5 % of 20,000 texts, toxic together and not alone, next to a slur that is toxic alone and to words
    that tell nothing: a text of both is toxic, and neither alone is."""
    r = np.random.RandomState(3)
    n = 20_000
    insult, named, slur = r.rand(n) < share, r.rand(n) < group, r.rand(n) < 0.04
    toxic = insult & named | slur
    noise = r.randint(100, 3000, (n, 30)).astype(np.uint64)
    terms = [(i, t) for i in range(n) for t in {*([1] * bool(insult[i])), *([2] * bool(named[i])), *([3] * bool(slur[i])), *noise[i].tolist()}]
    row, term = (np.array(c, np.uint64) for c in zip(*terms))
    m = toxicity.fit(row.astype(np.int64), term, toxic)
    assert {1, 2, 3} <= set(m.terms.tolist())
    at = lambda ts: m.score(np.zeros(len(ts), np.int64), np.searchsorted(m.terms, np.array(ts, np.uint64)), 1)[0] > m.threshold
    assert at([1, 2]) and at([3]) and not at([1]) and not at([2])


def test_partners_against_counting():
    r = np.random.RandomState(4)
    n, p = 3000, 12
    x = r.rand(n, p) < r.rand(p) * 0.2 + 0.05
    toxic = x[:, 0] & x[:, 1] | x[:, 2] & (r.rand(n) < 0.5)
    heads = np.zeros(p, bool)
    heads[[0, 2, 5]] = True
    want = set()
    for s in np.flatnonzero(heads):
        for t in range(p):
            both = x[:, s] & x[:, t]
            n, hit, rates = both.sum(), toxic[both].sum(), (toxic[x[:, s]].mean(), toxic[x[:, t]].mean())
            for more, rate in ((hit - n * max(rates), max(rates)),):
                if n >= toxicity.PAIR_DOCS and more >= toxicity.PAIR_MORE and more >= toxicity.PAIR_Z * np.sqrt(n * rate * (1 - rate)):
                    want |= {s, t}
    row, at = np.nonzero(x)
    old = toxicity.PAIR_CELLS
    for cells in (old, 30):
        toxicity.PAIR_CELLS = cells
        assert set(np.flatnonzero(toxicity.partners(row, at, toxic, heads))) == want and want
    toxicity.PAIR_CELLS = old


def brute_scores(m, rows):
    """Scores by the definition, pair by pair."""
    place, out = {int(t): k for k, t in enumerate(m.terms)}, {}
    for i, text in rows:
        held = [place[h] for h in {int(h) >> (64 - textops.TERM_BITS) for h in textops.hash_words(text or "")} if h in place]
        out[i] = m.w0 + sum(m.w[a] for a in held) + sum(m.v[a] @ m.v[b] for k, a in enumerate(held) for b in held[:k])
    return out


def brute_toxic(m, rows):
    return {i for i, s in brute_scores(m, rows).items() if s > m.threshold}


def test_toxicity_query_against_the_sum_over_pairs(spark, docs, rows):
    """The query, with the model that the same rows train."""
    m = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = brute_scores(m, rows)
    for r in queries.op3_toxicity(spark, SF).collect():
        assert np.isclose(r.score, want[r.doc_id]) and r.toxic == (r.score > m.threshold)


def test_factorization_score_is_the_sum_over_pairs():
    r = np.random.RandomState(2)
    m = toxicity.FactorizationMachine(np.arange(5, dtype=np.uint64), 0.3, r.rand(5), r.rand(5, 4), 0.0)
    pairs = sum(m.v[a] @ m.v[b] for a, b in ((0, 2), (0, 4), (2, 4)))
    assert np.isclose(m.score(np.zeros(3, int), np.array([0, 2, 4]), 1)[0], 0.3 + m.w[[0, 2, 4]].sum() + pairs)


# --- 4


def test_language_held_out(spark):
    """Accuracy on rows whose language the centroids were not told."""
    from pyspark.sql import functions as F

    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    odd = spark.createDataFrame([(10**9, "0101 1100 " * 100, None, "x", 1), (10**9 + 1, "数学 物理 化学 " * 60, None, "x", 1)], d.schema)
    held = {r.doc_id: r.lang for r in d.where("doc_id % 3 = 0 AND text IS NOT NULL").collect()}
    told = d.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = {r.doc_id: r for r in language.identify(told.unionByName(odd)).collect()}
    assert sum(got[i].language == held[i] for i in held) / len(held) > 0.97
    assert got[10**9].rejected and got[10**9 + 1].rejected and got[10**9].language is None


def brute_vector(text, idf):
    """A text's vector by its definition."""
    raw, count = text.lower().encode(), defaultdict(int)
    for k in (2, 3):
        for i in range(len(raw) - k + 1):
            h = int(language._SALT[0][raw[i]])
            for j in range(1, k):
                h ^= int(language._SALT[j][raw[i + j]]) * (2 * k + 1) % 2**32
            count[h * 0x9E3779B1 % 2**32 >> 20] += 1
    v = np.zeros(language.BUCKETS)
    for b, n in count.items():
        v[b] = np.log1p(n) * idf[b]
    return v / max(np.linalg.norm(v), 1e-12)


def test_language_query_against_all_centroids(spark, docs, rows):
    """The query by the definition: frequencies of all rows, cosines with every centroid, the radius of the nearest."""
    m = language.train(docs)
    seen = np.zeros(language.BUCKETS)
    vectors = {i: brute_vector(t or "", np.ones(language.BUCKETS)) for i, t in rows}
    for v in vectors.values():
        seen += v > 0
    some = sum(v.any() for v in vectors.values())
    assert np.allclose(m.idf, np.log((1 + some) / (1 + seen)) + 1, atol=1e-5)
    got = {r.doc_id: r for r in queries.op4_language(spark, SF).collect()}
    for i, t in rows:
        v = brute_vector(t or "", m.idf)
        cosine = m.centres.astype(float) @ v
        k = int(np.argmax(cosine))
        size = max(0, int(np.searchsorted(language.SIZES, len(t or ""), "right")) - 1)
        edge = 1 - cosine[k] - m.radius[k, size]
        assert np.isclose(got[i].cosine, cosine[k], atol=1e-4)
        if abs(edge) > 1e-4 and np.sort(cosine)[-1] - np.sort(cosine)[-2] > 1e-4:
            assert (got[i].language, got[i].rejected) == ((None, True) if edge > 0 or not v.any() else (m.languages[k], False))


def test_language_is_learned_from_all_rows(spark, monkeypatch):
    """Centroids are those of k-means over all rows, after ROUNDS from where it starts; radii hold for 0.99 of all rows."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL AND lang = 'en'")
    texts = pa.array([r.text for r in d.select("text").collect()])
    assert len(texts) > 1500
    m = language.train(d)
    x = language.vectors(texts, m.idf)
    x = x[x.any(1)]
    rounds = language.ROUNDS
    monkeypatch.setattr(language, "ROUNDS", 0)
    mean = language.train(d).centres
    assert ((mean * m.centres).sum(1) < 0.9999).any()
    for _ in range(rounds):
        at = np.argmax(x @ mean.T, 1)
        mean = np.stack([x[at == k].mean(0) for k in range(len(mean))])
        mean /= np.linalg.norm(mean, axis=1, keepdims=True)
    assert np.allclose(np.sort((mean @ m.centres.T).max(1)), 1, atol=1e-5)
    for k, size in enumerate(language.SIZES.tolist()):
        long = [t[:size] for t in texts.to_pylist() if len(t) >= size]
        if long:
            far = np.sort(1 - (language.vectors(pa.array(long), m.idf) @ m.centres.T).max(1))
            assert abs(m.radius[0, k] - far[int(np.ceil(language.QUANTILE * len(far))) - 1]) < 1e-4


def test_language_rejects_what_it_has_not_seen(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = random.Random(7)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    unseen = [
        "Suomi on Pohjois-Euroopassa sijaitseva valtio, jonka rajanaapurit ovat Ruotsi, Norja ja Venäjä. Maan pääkaupunki on Helsinki.",
        "Россия является крупнейшим по площади государством мира. Столица страны находится в Москве.",
        "中国位于亚洲东部,太平洋西岸,是世界上人口最多的国家之一。首都北京是全国的政治和文化中心。",
        "Polska jest państwem położonym w Europie Środkowej między Morzem Bałtyckim a Karpatami. Stolicą kraju jest Warszawa.",
        "Jamhuri ya Kenya ni nchi iliyoko Afrika ya Mashariki, mji mkuu wake ni Nairobi na lugha rasmi ni Kiswahili.",
        "Magyarország közép-európai ország, fővárosa Budapest, hivatalos nyelve a magyar, lakosainak száma csaknem tízmillió.",
        "for (int i = 0; i < n; ++i) { if (a[i] > max) { max = a[i]; idx = i; } } return std::make_pair(max, idx); // #include <vector>",
        some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 600),
        some("0123456789abcdef", 600),
        "<div class='x'><span id=a1>{{ v.k }}</span></div>" * 5,
    ]
    odd = spark.createDataFrame([(10**9 + k, t, None, "x", 1) for k, t in enumerate(unseen)], d.schema)
    want = {x.doc_id: x.lang for x in d.select("doc_id", "lang").collect()}
    got = {x.doc_id: x for x in language.identify(d.unionByName(odd)).collect()}
    assert [t for k, t in enumerate(unseen) if not got[10**9 + k].rejected] == []
    assert sum(got[i].language == want[i] for i in want) / len(want) > 0.98
    assert sum(got[i].rejected for i in want) / len(want) < 0.01


# --- 5


def test_bk_trees_find_what_brute_force_finds():
    r = np.random.RandomState(3)
    base = r.randint(0, 1 << 62, (60, 2)).astype(np.uint64)
    codes = np.repeat(base, 5, 0)
    for k in range(len(codes)):
        for b in r.randint(0, 128, r.randint(0, 14)):
            codes[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    shard = np.sort(r.randint(0, 3, len(codes)))
    forest = simhash.Forest(codes, shard)
    got = {(int(q), int(k), int(d)) for a, b, c in forest.near(simhash.RADIUS, chunk=50) for q, k, d in zip(a, b, c)}
    dist = lambda i, j: bin(int(codes[i, 0] ^ codes[j, 0])).count("1") + bin(int(codes[i, 1] ^ codes[j, 1])).count("1")
    want = {(i, j, dist(i, j)) for i in range(len(codes)) for j in range(i) if shard[i] == shard[j] and dist(i, j) <= simhash.RADIUS}
    assert got == want
    root = forest.root[0]
    child = forest.kids[forest.first[root] : forest.first[root + 1]]
    assert len(set(forest.edge[child])) == len(child) and all(dist(c, root) == forest.edge[c] for c in child)


@pytest.mark.parametrize("leaf", [1, 12, 64])
def test_trees_of_any_size_with_bits_that_agree(monkeypatch, leaf):
    """Lists and edges find the same; a shard's codes agree in some bits, and some are copies."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", 300)
    r = np.random.RandomState(4)
    size = np.array([1, 2, 70, 5, 12, 13, 1, 40, 64, 65, 3])
    shard = np.repeat(np.arange(len(size)), size)
    mask, base = (r.randint(0, 1 << 62, (2, len(size), 2)).astype(np.uint64) for _ in range(2))
    far = np.bitwise_and.reduce(r.randint(0, 1 << 62, (3, len(shard), 2)).astype(np.uint64), 0)  # 15 of 120 bits, about
    codes = base[0][shard] ^ (far & ~mask[0][shard])
    codes[5:9], codes[100] = codes[4], codes[95]
    got = [(int(q), int(k), int(d)) for a, b, c in simhash.Forest(codes, shard, mask[0][shard, 0]).near(simhash.RADIUS, chunk=50) for q, k, d in zip(a, b, c)]
    dist = np.bitwise_count(codes[:, None] ^ codes[None]).sum(2, dtype=int)
    want = {(i, j, int(dist[i, j])) for i in range(len(codes)) for j in range(i) if shard[i] == shard[j] and dist[i, j] <= simhash.RADIUS}
    assert set(got) == want and len(got) == len(want) > 500
    assert list(simhash.Forest(codes[:0], shard[:0]).near(simhash.RADIUS)) == []


def test_time_of_a_large_tree():
    """Pairs in a shard grow as the square of its codes, so each has to be cheap: following edges to every code took 60 s a 10^9 pairs and more."""
    r = np.random.RandomState(5)
    codes = r.randint(0, 1 << 62, (25_000, 2)).astype(np.uint64)
    codes[-1] = codes[7] ^ np.uint64(9)
    forest = simhash.Forest(codes, np.zeros(len(codes), np.int64))
    began = time.process_time()
    assert [(x.tolist(), y.tolist(), d.tolist()) for x, y, d in forest.near(simhash.RADIUS)] == [([24_999], [7], [4])]
    assert time.process_time() - began < 9  # 20 and more before


@pytest.mark.parametrize("family", simhash.FAMILIES)
def test_a_table_misses_every_near_difference(family):
    masks = simhash.covering(family)
    assert len(masks) == sum(2**k - 1 for k in family)
    r = np.random.RandomState(8)
    few = [r.choice(128, r.randint(0, simhash.RADIUS + 1), replace=False) for _ in range(4000)]
    few += [(r.randint(128) + np.arange(simhash.RADIUS)) % 128 for _ in range(200)]
    for bits in few:
        x = np.zeros(2, np.uint64)
        for b in bits:
            x[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        assert ((masks & x) == 0).all(1).any()


def majority_code(text):
    """A code by its definition."""
    hashes = {int(h) >> (64 - textops.TERM_BITS) for h in textops.hash_words(text)}
    if not hashes:
        return None
    h = np.array(sorted(hashes), np.uint64)
    two = np.stack([textops.mix(h), textops.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1)
    bits = np.unpackbits(two.view(np.uint8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=int) > len(h))


def brute_near(rows):
    """What near_groups returns, from all pairs; rows of unique ids."""
    by = defaultdict(list)
    for i, t in rows:
        c = majority_code(t or "")
        by[None if c is None or i is None else c.tobytes()].append(i)
    codes = [c for c in by if c is not None]
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), 16), axis=1).astype(np.float32)
    far = bits.sum(1)[:, None] + bits.sum(1)[None, :] - 2 * bits @ bits.T
    near = (far <= simhash.RADIUS) & ~np.eye(len(codes), dtype=bool)
    root = [min(by[c]) for c in codes]
    pairs = list(zip(*np.nonzero(near)))
    for _ in range(len(codes)):
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    out = {(i, i, 0, 1, False) for i in by.get(None, ())}
    for k, c in enumerate(codes):
        out |= {(i, root[k], int(near[k].sum()), len(by[c]), i != root[k]) for i in by[c]}
    return out


@pytest.mark.parametrize("hot", [simhash.HOT, 40])
@pytest.mark.parametrize("family", [0, 1])
def test_near_groups_against_all_pairs(spark, monkeypatch, hot, family):
    """Every link of every text, short ones too, with shards cut into blocks or whole."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "FAMILIES", simhash.FAMILIES[family:])
    r = random.Random(9)
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    base = [f"word{r.randrange(10**6)}" for _ in range(120)]
    more = [" ".join([w for w in base if r.random() > 0.03] + [f"x{r.randrange(10**6)}"]) for _ in range(150)]  # a group of near copies
    more += ["a b c d e f g", "a b c d e f g h", "b a c d e f g", "a b", "b a", "a", "z", "", None, ". ,"]
    for k in range(40):  # short texts, some near to others
        short = [f"s{k}{c}" for c in "abcdefg"[: 3 + k % 5]]
        more += [" ".join(short), " ".join([*short, "more"])]
    rows += [(10**6 + k, t) for k, t in enumerate(more)]
    got = [tuple(x) for x in simhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()]
    want = brute_near(rows)
    assert set(got) == want and len(got) == len(rows)
    assert max(x[2] for x in got) > 100 and any(0 < x[2] for x in got if x[0] >= 10**6 + 150)


def test_near_query(spark, rows):
    assert {tuple(x) for x in queries.op5_simhash(spark, SF).collect()} == brute_near(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(a, a + 1) for a in range(0, 60)] + [tuple(sorted(r.sample(range(100, 180), 2))) for _ in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {x.node: x.root for x in simhash.components(links).df.collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


# --- 6


def greedy(tokens, capacity):
    room, cost, out = [capacity] * max(1, -(-sum(tokens) // capacity)), [0.0] * max(1, -(-sum(tokens) // capacity)), []
    for n in tokens:
        best = min((c, i) for i, c in enumerate(cost) if room[i] >= n) if any(r >= n for r in room) else None
        if best is None:
            room.append(capacity)
            cost.append(0.0)
            best = (0.0, len(room) - 1)
        i = best[1]
        room[i] -= n
        cost[i] += n + n * n / packing.QUADRATIC
        out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_assignment(tokens):
    tokens = sorted(tokens, reverse=True)
    assert packing.assign(np.array(tokens, np.int64), 64).tolist() == greedy(tokens, 64)


def real_tokens():
    """Token numbers by another encoder of the same vocabulary."""
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={x: k for k, x in enumerate(bpe.read_ranks(bpe.VOCABULARY))}, special_tokens={})
    return lambda t: len(e.encode_ordinary(t))


def direct_packing(rows):
    count, pieces = real_tokens(), []
    for i, t in rows:
        n = count(t)
        pieces += [(min(packing.SEQUENCE_TOKENS, n - a), i, a // packing.SEQUENCE_TOKENS, a) for a in range(0, n, packing.SEQUENCE_TOKENS)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    return {(s, i, k, a, n) for s, (n, i, k, a) in zip(greedy([p[0] for p in pieces], packing.SEQUENCE_TOKENS), pieces)}


def test_packing_query(spark, rows):
    assert {tuple(r) for r in queries.op6_packing(spark, SF).collect()} == direct_packing(rows)  # the fixture is one shard


def test_no_sequence_has_more_tokens_than_its_capacity(spark):
    """By the ids of the tokenizer, cut where the pieces say."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = {r.doc_id: r.ids for r in bpe.encode(d).collect()}
    held, seen = defaultdict(int), defaultdict(list)
    for r in packing.pack(d).collect():
        part = ids[r.doc_id][r.first_token : r.first_token + r.tokens]
        assert len(part) == r.tokens
        held[r.sequence] += len(part)
        seen[r.doc_id].append((r.first_token, r.tokens))
    assert max(held.values()) <= packing.SEQUENCE_TOKENS
    for i, parts in seen.items():
        assert [a for a, _ in sorted(parts)] == list(range(0, len(ids[i]), packing.SEQUENCE_TOKENS)) and sum(n for _, n in parts) == len(ids[i])
    assert seen.keys() == {i for i, x in ids.items() if x}


# --- 7


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    t = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + brute_match(x, y))
    return 1 + t[-1][-1]


TREE = st.recursive(st.sampled_from(["a", "b"]).map(lambda t: wrappers.Node(t)), lambda k: st.tuples(st.sampled_from("pq"), st.lists(k, max_size=4)).map(lambda x: _node(*x)), max_leaves=12)


def _node(label, kids):
    n = wrappers.Node(label)
    n.kids = list(kids)
    return n


@pytest.mark.parametrize("cells", [wrappers.CELLS, 2])
@settings(max_examples=80, deadline=None)
@given(x=TREE, y=TREE)
def test_tree_matching(cells, x, y):
    a, b = _node("r", [x, *x.kids]), _node("r", [y, *y.kids])
    a, b = wrappers.parse("".join(_html(k) for k in a.kids)), wrappers.parse("".join(_html(k) for k in b.kids))
    old, wrappers.CELLS = wrappers.CELLS, cells
    try:
        m = wrappers.Matcher()
        m.prepare(wrappers._number(a)), m.prepare(b)
        m.match(a, b)
        numbers = [n.number for n in wrappers._post_order(b) if n.number >= 0]
        assert m.score(a, b) == brute_match(a, b) == len(numbers) == len(set(numbers))
        assert numbers == sorted(numbers)  # order and ancestors are kept
    finally:
        wrappers.CELLS = old


def _html(n):
    return f"<{n.label}x>" + "".join(_html(k) for k in n.kids) + f"</{n.label}x>"


def test_template_and_slots(spark):
    page = "<html><body><div id=top><span>Site name</span><ul><li>Home</li><li>About</li></ul></div><h2>{0}</h2><p>{1}</p>{2}<p>Written by staff</p></body></html>"
    rows = [(i, f"https://site.example/{i}", page.format(f"Head {i}", f"Body {i}", f"<p>More {i}</p>" * (i % 3))) for i in range(20)]
    for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        i = r.page_id
        assert r.content == "\n".join([f"Head {i}", f"Body {i}"] + [f"More {i}"] * (i % 3)) and r.template_nodes == 4


def test_hosts_with_empty_pages_and_two_layouts(spark):
    article = "<html><body><div id=top><span>Site name</span></div><h2>Head {0}</h2><div class=text><p>Body {0}</p></div><p class=by>Written by staff</p></body></html>"
    listing = "<html><body><div id=top><span>Site name</span></div><table><tr><th>All posts</th></tr><tr><td>Item {0}</td></tr></table><div class=pager>Older posts</div></body></html>"
    rows = [(0, "https://two.example/0", None), (1, "https://two.example/1", ""), (2, "https://two.example/2", "<html><body></body></html>"), (3, "https://two.example/3", "<html><p>Error 3</p>")]
    rows += [(i, f"https://two.example/{i}", (article if i % 5 < 3 else listing).format(i)) for i in range(10, 60)]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i].content for i in range(4)] == ["", "", "", "Error 3"]
    for i in range(10, 60):
        want = f"Head {i}\nBody {i}" if i % 5 < 3 else f"Item {i}"
        assert (got[i].content, got[i].template_nodes) == (want, 2 if i % 5 < 3 else 3)


@pytest.mark.parametrize("sets", [50_000, 5])
def test_every_layout_of_a_host_has_a_template(spark, monkeypatch, sets):
    """Twelve layouts, of which some have two pages of 2,000, and pages like no other."""
    monkeypatch.setattr(wrappers, "SETS", sets, raising=False)
    page = "<html><body><div class=k{0}>" + "".join(f"<p class=k{{0}}x{k}>Same {k}</p>" for k in range(5)) + "<h2 class=k{0}h>Body {1}</h2></div></body></html>"
    kinds = [0] * 1900 + [k for k in range(1, 12) for _ in range(2 if k > 5 else 18)] + list(range(100, 110))
    rows = [(i, "https://many.example/", page.format(k, i)) for i, k in enumerate(kinds)]
    for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        if kinds[r.page_id] < 100:
            assert (r.content, r.template_nodes) == (f"Body {r.page_id}", 5)
        else:
            assert r.template_nodes == 0 and r.content.startswith("Same 0")


def test_varying_text_in_any_element_is_content(spark):
    page = "<html><head><title>Shop</title></head><body><form><h1>Our shop</h1><p>Body {0}</p><aside>Note {0}</aside><ul class=menu><li>Soup {0}</li></ul><button>Buy {0}</button></form><nav>Go {0}</nav><div class=ad>Ad {0}</div></body></html>"
    rows = [(i, f"https://forms.example/{i}", page.format(i)) for i in range(10)]
    for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        assert re.findall(r"\w+ \d", r.content) == [f"{w} {r.page_id}" for w in ("Body", "Note", "Soup", "Buy")]
        assert "Our shop" not in r.content and r.template_nodes == 1 and r.hidden_nodes == 3


def test_pages_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op7_wrappers(spark, SF).collect()}
    assert got.keys() == {p.page_id for p in pages}
    by_host = defaultdict(list)
    for p in pages:
        by_host[re.match("https?://([^/:]*)", p.url)[1].lower()].append(p)
    words = lambda h: re.findall(r"\w+", html.unescape(re.sub("<[^>]+>", " ", h)))
    kept = 0
    for p in pages:
        article = words(re.search("<article>(.*)</article>", p.html, re.S)[1])
        mine = re.findall(r"\w+", got[p.page_id].content)
        if mine == article:
            kept += 1
            continue
        # what is left out of the article stands in other pages of the host
        assert got[p.page_id].template_nodes and len(by_host[got[p.page_id].host]) > 1
        gone = Counter(article) - Counter(mine)
        assert Counter(mine) - Counter(article) == Counter() and all(sum(w in words(q.html) for q in by_host[got[p.page_id].host]) > 1 for w in gone)
    assert kept > 0.9 * len(pages)


def test_equal_texts_count_twice():
    """Of two ways to match siblings the one that pairs equal texts, by the definition with weight 2."""

    def weight(a, b, known):
        if a.label != b.label:
            return 0
        if a.label == "":
            return 2 if a.text == b.text else 1
        t = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + weight(x, y, known))
        return 1 + t[-1][-1]

    r = random.Random(6)
    for _ in range(200):
        page = lambda: "".join(f"<p>{r.choice('abcd')}</p>" if r.random() < 0.7 else f"<i>{r.choice('ab')}</i>" for _ in range(r.randrange(1, 7)))  # noqa: B023, E731
        a, b = wrappers.parse(page()), wrappers.parse(page())
        m, known = wrappers.Matcher(), frozenset()
        known = frozenset(n.text for n in wrappers._texts(a))
        m.prepare(wrappers._number(a), known), m.prepare(b, known)
        assert m.score(a, b) == weight(a, b, known)
        m.match(a, b)
        texts = {n.number: n.text for n in wrappers._texts(a)}
        matched = [n for n in wrappers._post_order(b) if n.number >= 0]
        assert len(matched) + sum(n.label == "" and texts[n.number] == n.text for n in matched) == m.score(a, b)


# --- 8


def brute_repeats(rows, size):
    one = {(i, t) for i, t in rows if t is not None}
    words = {k: ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall("[a-zA-Z0-9\x80-\U0010ffff]+", k[1])] for k in one}
    at = defaultdict(list)
    for k, w in words.items():
        for p in range(len(w) - size + 1):
            at[tuple(w[p : p + size])].append((k, p))
    marks = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for k, p in places:
                marks[k].add(p)
    out = set()
    for k, ps in marks.items():
        ps = sorted(ps)
        a, z = ps[0], ps[0] + size
        for p in ps[1:]:
            if p > z:
                out.add((k[0], a, z))
                a = p
            z = p + size
        out.add((k[0], a, z))
    return out, {k: len(v) for k, v in at.items()}


@pytest.mark.parametrize("ranges", [800_000, 400])
def test_repeats_against_brute_force(spark, docs, rows, ranges, monkeypatch):
    monkeypatch.setattr(suffix, "RANGE_SYMBOLS", ranges)
    got = {(r.doc_id, r.first_word, r.end_word) for r in suffix.find_repeats(docs).collect() if not r.cut}
    assert got == brute_repeats(rows, suffix.MIN_WORDS)[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_in_periodic_texts(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["a", "b"]) if r.random() < 0.3 else "a" for _ in range(r.randrange(0, 60)))) for i in range(40)]
    rows += [(None, rows[3][1]), (41, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x.doc_id, x.first_word, x.end_word) for x in suffix.find_repeats(df, min_words=6).collect() if not x.cut}
    assert got == brute_repeats(rows, 6)[0]


def test_cutting_leaves_one_of_each(spark, docs, rows):
    left = [(r.doc_id, r.text) for r in suffix.drop_repeats(docs).collect()]
    before, after = brute_repeats(rows, suffix.MIN_WORDS)[1], brute_repeats(left, suffix.MIN_WORDS)[1]
    old = {k for k, n in before.items() if n > 1}
    assert all(after.get(k, 0) <= 1 for k in old)
    clean = {i for i, _ in rows} - {i for i, *_ in brute_repeats(rows, suffix.MIN_WORDS)[0]}
    assert {(i, t) for i, t in left if i in clean} == {(i, t) for i, t in rows if i in clean}


def test_the_sort_sorts():
    """Names and merged ranks of random texts are the order of their suffixes, as far as a symbol of the last level reaches."""
    r = np.random.RandomState(5)
    for _ in range(20):
        s = np.concatenate([r.randint(1, 4, r.randint(3, 60)), [0, 0, 0]]).astype(np.uint64)
        assert (_ranks(s, 4)[: len(s) - 3] == _order(s)).all() or _same_order(_ranks(s, 4)[: len(s) - 3], s)


def _ranks(s, levels):
    """Ranks by position by the operator's own steps, without Spark."""
    at = np.arange(len(s) - 2)
    sample = at[(at % 3 != 0) & (s[at] > 0)]
    t = np.stack([s[sample], s[sample + 1], s[sample + 2]], 1)
    _, name = np.unique(t, axis=0, return_inverse=True)
    place = suffix._below(sample, len(s))
    n = len(range(1, len(s) - 2, 3)) + len(range(2, len(s) - 2, 3)) + 6
    below = np.zeros(max(n, int(place.max(initial=0)) + 4), np.uint64)
    below[place] = name.astype(np.uint64).ravel() + np.uint64(1)
    rank = below.copy()
    if levels > 1:
        deeper = _ranks(below, levels - 1)
        rank[: len(deeper)] = deeper[: len(rank)]
    up = suffix._unfold(len(s), rank)
    at, cols = suffix._suffixes(s, up)
    real = s[at] > 0
    out = np.zeros(len(s), np.uint64)
    out[at[real]] = suffix._merge(at[real] % 3, *[c[real] for c in cols]).astype(np.uint64) + np.uint64(1)
    return out


def _order(s):
    n = len(s) - 3
    keys = [tuple(s[i:n].tolist()) for i in range(n)]
    return np.array([sorted(keys).index(k) + 1 for k in keys], np.uint64)


def _same_order(rank, s):
    n = len(s) - 3
    keys = [tuple(s[i:n].tolist()) for i in range(n)]
    return all((rank[i] < rank[j]) == (keys[i] < keys[j]) for i in range(n) for j in range(n) if keys[i][:50] != keys[j][:50])


# --- 9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=60), st.lists(st.integers(0, 40), max_size=60))
def test_quotient_filters_merge_losslessly(a, b):
    build = lambda v: exact.CountingQuotientFilter.build(np.array(v, np.uint64))
    both = exact.CountingQuotientFilter.loads(build(a).dumps()).merge(build(b))
    whole = build(a + b)
    assert both.dumps() == whole.dumps()
    keys, counts = both.items()
    assert dict(zip(keys.tolist(), counts.tolist())) == {x: (a + b).count(x) for x in set(a + b)}
    assert all(both.count(x) == (a + b).count(x) for x in [*a[:5], *b[:5], 77])


def test_collisions_are_settled_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id bigint, text string")
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    assert {(r.doc_id, r.keep_id, r.copies) for r in exact.find_copies(df).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}
    assert {r.doc_id for r in exact.drop_copies(df).collect()} == {1, 2, 4}


# --- 10


def test_licences_against_brute_force(spark, docs, rows):
    grams = lambda t: (lambda w: {*zip(w, w[1:])})(re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower()))
    want = set()
    for i, text in rows:
        units = text.split("\n") + re.split(r"\n(?:[^a-zA-Z0-9\x80-\U0010ffff\n]*\n)+", text) + [text]
        sets = [g for u in units if (g := grams(u))]
        for name, licence, t in licences.TEMPLATES:
            g = grams(t)
            best = max((2 * len(u & g) / (len(u) + len(g)) for u in sets), default=0)
            if best >= licences.THRESHOLD:
                want.add((i, name, licence, round(best, 6)))
    assert {tuple(r) for r in licences.scan(docs).collect()} == want


def test_licences_within_other_text(spark):
    full = {n: t for n, _, t in licences.TEMPLATES}
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice("river stone letter garden winter copper quiet lantern market".split()) for _ in range(n))
    mit = re.sub(r" (The above copyright|THE SOFTWARE IS PROVIDED)", r"\n\n\1", full["mit-text"], count=2)
    bsd = re.sub(r" (1\. Redist|2\. Redist|THIS SOFTWARE IS PROVIDED)", r"\n\n\1", full["bsd-2-text"])
    gpl = re.sub(r" (This program is distributed|See the GNU)", r"\n\n\1", full["gpl-3-notice"])
    assert mit.count("\n\n") == 2 and bsd.count("\n\n") == 3
    rows = [
        (1, f"{prose(300)}\n\nCopyright 2020 someone\n\n{mit}\n\n{prose(400)}", "mit-text"),
        (2, f"/* {prose(90)}\n\n{bsd}\n\n{prose(200)} */", "bsd-2-text"),
        (3, f"{prose(50)}\n\n{gpl}\n\n{prose(500)}", "gpl-3-notice"),
        (4, "mylib 1.2 is released under the MIT License, see LICENSE for details.", "mit-notice"),
        (5, " ".join([full["mit-text"]] * 3), "mit-text"),
        (6, prose(900), None),
        (7, f"{prose(200)}\n\n{full['apache-2-text']}\n\n{prose(300)}", "apache-2-text"),
        (8, f"{full['unlicense-text']} {prose(700)} {full['mpl-2-notice']} {full['zlib-text']}", "zlib-text"),
    ]
    grams = lambda w: {*zip(w, w[1:])}
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower())
    want = set()
    for i, text, name in rows:
        w = words(text)
        found = set()
        for k, licence, t in licences.TEMPLATES:
            g, n = grams(words(t)), len(words(t))
            units = [grams(w[a : a + n]) for a in range(len(w) - n + 1)] + [grams(words(u)) for u in (*text.split("\n"), *text.split("\n\n"), text)]
            best = max((2 * len(u & g) / (len(u) + len(g)) for u in units if u), default=0)
            if best >= licences.THRESHOLD:
                found.add((i, k, licence, round(best, 6)))
        assert name in {k for _, k, _, _ in found} if name else not found
        want |= found
    assert {tuple(x) for x in licences.scan(spark.createDataFrame([x[:2] for x in rows], "doc_id bigint, text string")).collect()} == want


# --- the pipeline


def test_pipeline_against_brute_force(spark, docs):
    """Each stage on its own input, by other means where these are exact."""
    sf, d = SF, docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in d.collect()]
        out = stage(spark, d, sf)
        if name == "packing":
            assert {tuple(r) for r in out.collect()} == direct_packing(before)
            break
        after = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == d.columns
        if name == "toxicity":
            assert {i for i, _ in before} - {i for i, _ in after} == brute_toxic(toxicity.train(d, spark.read.parquet(f"{sf}/labels.parquet")), before)
        elif name == "exact dedup":
            first = {}
            for i, t in before:
                first[t] = min(i, first.get(t, i))
            assert sorted(after) == sorted((i, t) for t, i in first.items())
        elif name == "SimHash near-dedup":
            assert sorted(i for i, _ in after) == sorted({x[1] for x in brute_near(before)})
        else:
            old, new = brute_repeats(before, suffix.MIN_WORDS), brute_repeats(after, suffix.MIN_WORDS)
            assert all(new[1].get(k, 0) <= 1 for k, n in old[1].items() if n > 1)  # a repeated window stays once at most
            clean = {i for i, _ in before} - {i for i, *_ in old[0]}
            assert {x for x in after if x[0] in clean} == {x for x in before if x[0] in clean}
        d = spark.createDataFrame([r.asDict() for r in out.collect()], d.schema)
    packed = corpus_pipeline.run(spark, sf)
    assert packed.columns == ["sequence", "doc_id", "piece", "first_token", "tokens"] and packed.count() > 0
