"""Every operator and stage with nulls in any column, empty and very long texts, ties, repeated rows, no rows, and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import bpe, exact, fingerprints, language, licences, packing, simhash, suffix, toxicity, wrappers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASH = ("key", "fp", "dup", "score", "gone", "spans", "rn", "bucket", "id", "rep", "host", "_score", "html", "SPANS")


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(r.randrange(500)) for _ in range(n))


ROWS = [
    (1, "one two three", "en", "a", 13),
    (1, "one two three", "en", "a", 13),  # a repeated row
    (2, "one two three", "en", "a", 13),  # a tie
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (None, "one two three", "en", None, 13),
    (None, None, None, None, None),
    (5, words(30_000, 5), "en", "b", None),  # a long text
    (6, words(80, 6), None, "b", 1),
    (7, words(80, 6) + " tail", "en", None, 2),
    (8, "x", "de", "c", 1),
    (9, "\n\n \t", "de", "c", 4),
    (10, "\U0001f642 ß İ é\x00", "de", "c", 8),
]
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, None), (None, 0, 1), (4, None, 0), (6, 1, 0)], LABELS)


def per_row(docs, labels):
    return {
        "fingerprint": fingerprints.fingerprint(docs),
        "bpe": bpe.encode(docs),
        "toxic": toxicity.find_toxic(docs, labels),
        "language": language.identify(docs),
        "copies": exact.find_copies(docs),
        "near": simhash.near_groups(docs),
    }


def several(docs, labels):
    return {"packing": packing.pack(docs), "repeats": suffix.find_repeats(docs), "licences": licences.scan(docs)}


def filters(docs, labels):
    return {"toxic": toxicity.drop_toxic(docs, labels), "copies": exact.drop_copies(docs), "near": simhash.drop_near_copies(docs), "repeats": suffix.drop_repeats(docs)}


def test_row_operators_keep_every_row(docs, labels):
    want = sorted((r[0] for r in ROWS), key=str)
    for name, df in per_row(docs, labels).items():
        assert sorted((r.doc_id for r in df.collect()), key=str) == want, name


def test_values_of_nulls_and_empty_texts(docs, labels):
    """What the docstrings promise, by operator."""
    at = lambda df, i: [r for r in df.collect() if r.doc_id == i]
    f = fingerprints.fingerprint(docs)
    assert tuple(at(f, 3)[0])[1:] == (None,) * 6 and tuple(at(f, 4)[0])[1:] == (0, 0, 0, 1, 0, 0)
    assert len({tuple(r)[1:] for r in at(f, 1) + at(f, 2)}) == 1 and len(at(f, 1)) == 2 and len(at(f, None)) == 2
    e = bpe.encode(docs)
    assert tuple(at(e, 3)[0])[1:] == (None, None, None) and tuple(at(e, 4)[0])[1:] == (0, True, []) and len({tuple(r.ids) for r in at(e, 1) + at(e, 2)}) == 1
    t, m = toxicity.find_toxic(docs, labels), toxicity.train(docs, labels)
    assert all(r.score == m.w0 and not r.toxic for i in (3, 4, 9) for r in at(t, i)) and len({r.score for r in at(t, 1) + at(t, 2)}) == 1
    g = language.identify(docs)
    assert all(tuple(r)[1:] == (None, 0.0, True) for i in (3, 4, 8) for r in at(g, i)) and len({(r.language, r.cosine) for r in at(g, 1) + at(g, 2)}) == 1


def test_licence_edges(spark):
    line = "Released under the MIT License."
    rows = [(1, line), (1, line), (2, line), (None, line), (3, None), (4, ""), (5, "licence"), (6, "word " * 200_000 + line)]
    got = sorted((tuple(r) for r in licences.scan(spark.createDataFrame(rows, "doc_id int, text string").withColumn("template", F.lit("x"))).collect()), key=repr)
    want = ("mit-notice", "MIT", 1.0)
    assert [r for r in got if r[1] == "mit-notice"] == sorted([(1, *want), (1, *want), (2, *want), (None, *want), (6, *want)], key=repr) and not {3, 4, 5} & {r[0] for r in got}


def test_ids_of_any_integer_type(docs, labels):
    """An int id gives what a bigint gives."""
    narrow = lambda d: d.withColumn("doc_id", F.col("doc_id").cast("int"))
    for f in (lambda d, x: toxicity.find_toxic(d, x), lambda d, _: language.identify(d), lambda d, _: licences.scan(d)):
        assert sorted(map(repr, f(docs, labels).collect())) == sorted(map(repr, f(narrow(docs), narrow(labels)).collect()))


def test_no_rows(spark, docs, labels):
    none, bare = docs.limit(0), labels.limit(0)
    for f in (per_row, several, filters):
        for name, df in f(none, bare).items():
            assert df.collect() == [], name
    assert wrappers.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_no_labels_reject_nothing(docs, labels):
    assert not any(r.toxic for r in toxicity.find_toxic(docs, labels.limit(0)).collect())


def test_others_run(docs, labels):
    for name, df in several(docs, labels).items():
        assert df.collect() is not None, name


def test_clashing_names(docs, labels):
    more = docs
    for c in CLASH:
        if c.lower() not in {x.lower() for x in more.columns}:
            more = more.withColumn(c, F.lit(c))
    plain, wide = filters(docs, labels), filters(more, labels)
    for name, df in wide.items():
        assert df.columns == more.columns, name
        rows = df.collect()
        assert all(r["score"] == "score" for r in rows)
        assert sorted(map(repr, df.select(docs.columns).collect())) == sorted(map(repr, plain[name].collect())), name
    for f in (per_row, several):
        for (name, a), b in zip(f(docs, labels).items(), f(more, labels).values()):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name


def test_exact(docs):
    got = sorted(((r.doc_id, r.keep_id, r.copies, r.is_copy) for r in exact.find_copies(docs).collect() if r.copies > 1), key=str)
    assert got == sorted([(1, 1, 4, False), (1, 1, 4, False), (2, 1, 4, True), (None, 1, 4, False)], key=str)
    kept = [r.doc_id for r in exact.drop_copies(docs).collect()]
    assert kept.count(1) == 1 and 2 not in kept and kept.count(None) == 1 and 3 in kept and 4 in kept


def test_near(docs):
    got = sorted((tuple(r) for r in simhash.near_groups(docs).collect()), key=repr)
    alone = [(r[0], r[0], 0, 1, False) for r in ROWS if r[0] in (None, 3, 4, 5, 8, 9, 10)]
    assert got == sorted([(1, 1, 0, 3, False), (1, 1, 0, 3, False), (2, 1, 0, 3, True), (6, 6, 1, 1, False), (7, 6, 1, 1, True), *alone], key=repr)
    several = docs.sparkSession.createDataFrame([(1, "one two"), (2, "three four"), (2, "one two"), (3, "four three")], "doc_id int, text string")
    assert {(r.doc_id, r.keep_id) for r in simhash.near_groups(several).collect()} == {(1, 1), (2, 1), (3, 1)}
    kept = [r.doc_id for r in simhash.drop_near_copies(docs).collect()]
    assert kept.count(1) == 2 and kept.count(None) == 2 and 2 not in kept and 7 not in kept


def test_repeats(docs):
    got = sorted((r.doc_id, r.first_word, r.end_word, r.cut) for r in suffix.find_repeats(docs).collect())
    assert got == [(6, 0, 80, False), (7, 0, 80, False), (7, 0, 80, True)]
    kept = {(r.doc_id, r.text): r.n_chars for r in suffix.drop_repeats(docs).collect()}
    assert kept[7, "tail"] == 4 and kept[6, words(80, 6)] == 1 and len([k for k in kept if k[0] is None]) == 2


def test_packing(docs):
    rows = packing.pack(docs, capacity=1000).collect()
    ids = {r.doc_id for r in rows}
    assert 3 not in ids and 4 not in ids and sum(r.doc_id == 1 for r in rows) == 2 and None in ids
    assert sum(r.tokens for r in rows if r.doc_id == 5) == next(r.tokens for r in bpe.encode(docs).collect() if r.doc_id == 5)


def test_pipeline_stages(spark, docs, labels, tmp_path):
    for name, d in (("some", docs), ("none", docs.limit(0))):
        sf = f"{tmp_path}/{name}"
        d.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, d, sf).columns == d.columns, stage
        rows = corpus_pipeline.run(spark, sf).collect()
        # of the rows of one text, and of near ones, the least id stays; rows of no text go on and have nothing to pack
        assert {r.doc_id for r in rows} == ({1, 5, 6, 8, 9, 10} if name == "some" else set())


def test_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, "http://h.example/1", "<html><body><h1>Title</h1><p>same</p><p>one</p></body></html>"),
        (1, "http://h.example/1", "<html><body><h1>Title</h1><p>same</p><p>one</p></body></html>"),
        (2, "HTTP://user@H.example:80/2", "<html><body><h1>Title</h1><p>same</p><p>two<b>bold</body>"),
        (3, None, None),
        (4, "not a url", ""),
        (None, "http://k.example", deep),
        (6, "http://l.example", "<p" * 50 + "<<>> &amp; <!-- <script>"),
        (7, "http://l.example", "word " * 50_000),
        (8, "http://m.example", "<nav>menu</nav><script>x()</script><p>text</p><div class='ad'>buy</div>"),
    ]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("other")).withColumn("template", F.lit(1))
    got = {(r.page_id, r.content): r for r in wrappers.extract(d).collect()}
    assert len(wrappers.extract(d).collect()) == len(rows)
    assert got[1, "one"].template_nodes == 2 and got[2, "two bold"].template_nodes == 2 and got[2, "two bold"].host == "h.example"
    assert got[3, ""].slots == 0 and got[4, ""].slots == 0 and (None, "deep") in got and (8, "text") in got
