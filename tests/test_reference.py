"""The search engine: goldens, invariants, and every query against its SQL."""

import glob
import json
import math
import os
import struct

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom import queries as Q
from fathom.functions import facets as X
from fathom.functions import hashing as H
from fathom.functions import text as T
from fathom.functions import vectors as V
from fathom.operators import chunking, fusion, grouping, lifecycle, packer, telemetry, vector_search
from fathom.operators.filters import SearchFilters
from fathom.plans import artifact, caches, embedding, profiles
from fathom.plans import index as index_plan
from fathom.plans import search as search_plan
from fathom.sources import corpus, gguf, manifest_store, snapshot
from fathom.sources.vector_store import ReadOnlyError, ReadOnlyStore, StoreError, VectorStore

SF = "/root/testdata/sf0.001"


def values(spark, column, rows, schema="x double"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


# --- every query against its SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(Q.ORACLES[name])
    assert names == sorted(want.columns)
    a = sorted(repr([plain(v) for v in r]) for r in got.select(*names).collect())
    b = sorted(repr([plain(v) for v in r]) for r in want.select(*[f'"{n}"' for n in names]).fetchall())
    assert a == b


def test_the_others_run(spark):
    for name in set(Q.QUERIES) - set(Q.ORACLES):
        assert Q.QUERIES[name](spark, SF).count() > 0


# --- scores


def test_score_goldens(spark):
    x = F.col("x")
    assert values(spark, fusion.normalize_bm25(x), [0.0, 10.0, 90.0, math.nan, math.inf, -1.0]) == [0, 0.5, 0.9, 0, 1, 0]
    assert values(spark, fusion.normalize_semantic(x), [-1.0, 0.0, 1.0, math.nan]) == [0, 0.5, 1, 0]
    assert values(spark, fusion.thresholded(fusion.normalize_semantic(x), 0.6), [-1.0, 0.0, 1.0]) == [0, 0, 1]


@pytest.mark.parametrize("scores, want", [([0, 10, 25], [0, 0, 1]), ([0, 5, 15], [0, 1 / 3, 0.6])])
def test_adaptive_goldens(spark, scores, want):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, float(s)) for s in scores], "q int, s double")
    got = [r.n for r in df.withColumn("n", fusion.normalize_bm25_adaptive(F.col("s"), Window.partitionBy("q"))).orderBy("s").collect()]
    assert got == pytest.approx(want)


def test_fusion_goldens(spark):
    lists = "query_id bigint, line_id bigint, score double"
    make = lambda rows: spark.createDataFrame([(0, i, float(s)) for i, s in rows], lists)
    got = {r.line_id: (r.score, r.source) for r in fusion.fuse_rrf(make([(1, 1), (2, 2)]), make([(2, 1), (3, 2)])).collect()}
    assert got[2] == (pytest.approx(1 / 61 + 1 / 62), "Both") and got[1] == (pytest.approx(1 / 61), "Lexical") and got[3] == (pytest.approx(1 / 62), "Semantic")
    one = fusion.fuse_weighted(make([(1, 0.8)]), make([(1, 0.6)]), 0.5).first()
    assert (one.score, one.source) == (pytest.approx(0.7), "Both")


@pytest.mark.parametrize("scores, want", [([1, 0.8, 0.5], 0.2), ([0.5, 0.5], 0), ([1], None), ([0, 0], None), ([-1, -2], None)])
def test_confidence(spark, scores, want):
    df = spark.createDataFrame([(0, k, float(s)) for k, s in enumerate(scores)], "query_id bigint, line_id bigint, fused_score double")
    got = fusion.confidence(df).first().confidence
    assert got is None if want is None else got == pytest.approx(want)


def test_profiles_and_flags():
    flags = profiles.FeatureFlags
    assert flags(force_rrf=True, force_weighted=True, rrf_k=0).resolve(profiles.BALANCED).rrf_k == 1
    assert flags(bm25_adaptive_normalization=True).resolve(profiles.BALANCED).adaptive
    assert flags(bm25_adaptive_normalization=True).resolve(profiles.FAST).rrf_k == 60
    assert flags(semantic_threshold_override=math.nan).resolve(profiles.BEST).semantic_threshold == 0.55
    assert flags(agreement_bonus_override=7.0, phrase_match_enabled=False, phrase_match_bonus_override=0.5).resolve(profiles.BEST).agreement_bonus == 1
    assert flags(phrase_match_enabled=False, phrase_match_bonus_override=0.5).resolve(profiles.BEST).phrase_match_bonus == 0
    assert profiles.actual_mode(profiles.HYBRID, False) == profiles.LEXICAL_ONLY and profiles.actual_mode(profiles.SEMANTIC_ONLY, False) == profiles.SEMANTIC_ONLY
    assert [grouping.candidate_window(*a) for a in ((20, 40, 2.0), (20, 40, math.inf), (0, 0, 2.0), (10**9, 0, 2.0), (20, 0, 99.0))] == [80, 80, 1, 10_000, 200]


# --- text, facets, hashes


def test_text_functions(spark):
    t = lambda f, rows: values(spark, f(F.col("x")), rows, "x string")
    assert t(T.strip_points, ["שָׁלוֹם"]) == ["שלום"]
    assert t(T.normalize, ["  רש״י  ׳א \xa0\t b "]) == ["רש\"י 'א b"]
    assert t(T.normalize_for_cache, ["ABC Éא"]) == ["abc Éא"]
    assert t(T.detect_language, ["שלום רב", "hello", "שלום hello", "", "123", "הכי די", "אמר רבא הא", "בא", "אמר רב הונא לן מר"]) == ["Hebrew", "Other", "Mixed", "Other", "Other", "Aramaic", "Aramaic", "Aramaic", "Hebrew"]
    assert t(T.query_type, ["", "one", "one 2", "a b c", "a b c d e", 'say "x', '"']) == ["Unknown", "Short", "ExactReference", "Mixed", "Conceptual", "ExactReference", "ExactReference"]
    assert t(T.alpha, ["", "one", "one 2", "a b c", "a b c d e", 'say "x']) == [0.5, 0.7, 0.85, 0.5, 0.3, 1.0]
    assert values(spark, T.alpha("x", True), ['רש"י על התורה'], "x string") == [0.5]
    assert t(T.quoted_phrases, ['"a b" c "  " "d', 'x "y" z']) == [["a b"], ["y"]]
    assert t(lambda c: T.truncate_chars(c, 2), ["\U0001f642ab"]) == ["\U0001f642a"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab1 \"אבּ׳״\t\xa0", max_size=25))
def test_twins_agree(spark, q):
    row = spark.createDataFrame([(q,)], "q string").select(T.normalize("q").alias("n"), T.query_features("q").alias("f"), T.alpha("q").alias("a")).first()
    ours = search_plan.analyze(q)
    assert search_plan.normalize(q) == row.n
    assert (ours.token_count, ours.has_quoted_phrase, ours.estimated_type, list(ours.rare_tokens), list(ours.quoted_phrases), ours.alpha) == (row.f.token_count, row.f.has_quoted_phrase, row.f.estimated_type, row.f.rare_tokens, row.f.quoted_phrases, row.a)


def test_facets(spark):
    paths = ["/author/x", "/era/x", "/base", "/authors/x", "a/b"]
    assert values(spark, X.dimension(F.col("x")), paths, "x string") == [1, 2, 3, 0, 0] == [X.dimension_of(p) for p in paths]
    assert values(spark, X.matches(F.col("x"), " /a/b/ "), ["/a/b", "/a/b/c", "/a/bc", "/a", " /a/b/ "], "x string") == [True, True, False, False, True]
    assert values(spark, X.matches_exactly(F.col("x"), "/a/"), ["/a/", "/a", "/a/b"], "x string") == [True, False, False]
    row = spark.createDataFrame([(["b", " ", "a", "b", "Z", "א"],)], "f array<string>").select(X.canonical(F.col("f"))).first()[0]
    assert row == ["Z", "a", "b", "א"]


def test_filters(spark):
    v = spark.createDataFrame([("a", ["/x/y", "/era/1"], False), ("b", ["/x", "/era/2", "/author/q"], True), ("c", ["/z"], False)], "source_book_key string, facets array<string>, is_pdf boolean")
    keys = lambda **k: "".join(sorted(r[0] for r in SearchFilters(**k).apply(v).select("source_book_key").collect()))
    assert keys() == keys(facets=(), book_paths=()) == keys(include_pdf=True) == "abc"
    assert keys(include_pdf=False) == "ac" and keys(facets=("/x",)) == "ab" and keys(facets=("/x", "/z")) == "abc"
    assert keys(facets=("/x", "/era/1", "/era/2")) == "ab" and keys(facets=("/x/y", "/era/2")) == "" and keys(book_paths=("c",)) == "c"
    assert SearchFilters().is_empty and SearchFilters().predicate() is None and not SearchFilters(include_pdf=False).is_empty


def test_hash_goldens(spark):
    assert H.ChunkerConfig().identity == 10487043358308809960 and H.ChunkerConfig(max_chunk_chars=10).identity == 8911299436012603488
    sid = lambda i: spark.range(1).select(H.semantic_id(F.lit("book.txt"), F.lit(1), i)).first()[0]
    assert sid(1) == "54122bff9d087b3af9c80a3b0668e41f" and sid(H.ChunkerConfig().identity) == "e454aedb3e9f411d0ebc3453bf87a95b"
    assert values(spark, H.chunk_hash(F.col("x")), ["א"], "x string") == ["defba94d071a3373c27b4b15959db14a"]
    assert H.fnv1a("שלום abc".encode()) == 5589480351402094742
    assert values(spark, H.fnv1a_column(F.col("x")), ["שלום abc", "", None] * 40, "x string") == [5589480351402094742, H.signed(H.OFFSET), H.signed(H.OFFSET)] * 40
    assert H.canonical_fingerprint(0xBEEFCAFE, "T", "/a", ["/author/y", "/era/x"], False) == 17173339796141585561
    assert H.canonical_fingerprint(0, "T", "/a", [], False) == 0
    assert values(spark, H.unsigned_text(F.col("x")), [-1, 5], "x bigint") == ["18446744073709551615", "5"]
    assert spark.range(1).select(H.line_id(F.lit(1), F.lit(2))).first()[0] == (2 << 32) + 3


def test_vectors(spark):
    v = V.hash_embedding("hello world", 8)
    assert v.tolist() == [0.5, 0, 0, 0, -1.25, 0.5, 0, 0] and not V.hash_embedding(" \t", 8).any()
    rows = [([1.0, 2.0],), ([1.0],), ([math.nan, 1.0],), ([0.0, 0.0],), (None,), ([math.inf, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(V.reject_reason(F.col("v"), 2)).collect()] == [None, "dimension", "component", "norm", "dimension", "component"]


# --- search, groups, pages


def _store_rows(n=20):
    return [(f"{k:04d}", "a" if k % 2 else "b", k, [math.cos(0.05 * k), math.sin(0.05 * k)], ["/x"], False) for k in range(n)]


VECTORS = "semantic_id string, source_book_key string, line_id bigint, vector array<float>, facets array<string>, is_pdf boolean"


def test_top_k(spark):
    v = spark.createDataFrame(_store_rows(), VECTORS)
    assert [r.line_id for r in vector_search.search(v, [1.0, 0.0], 5).collect()] == [0, 1, 2, 3, 4]
    ties = spark.createDataFrame([(f"{k:02d}", "a", k, [1.0, 0.0], [], False) for k in reversed(range(12))], VECTORS)
    assert [r.line_id for r in vector_search.search(ties, [2.0, 0.0], 4).collect()] == [0, 1, 2, 3]
    for q, k in (([0.0, 0.0], 3), ([math.nan, 1.0], 3), ([1.0, 0.0], 0)):
        assert vector_search.search(v, q, k).collect() == []
    with pytest.raises(ValueError):
        vector_search.search(v, [1.0], 3, dim=2)
    plan = vector_search.search(v, [1.0, 0.0], 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_batched_search_equals_single(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    v = spark.createDataFrame(_store_rows(30) + [("x1", "a", 100, [1.0, 0.0], [], False)], VECTORS)
    q = v.select(F.col("line_id").alias("query_id"), "vector")
    got = {}
    for r in vector_search.search_all(v, q, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.line_id
    for r in q.collect():
        want = [x.line_id for x in vector_search.search(v, list(r.vector), 4).orderBy(F.desc("similarity"), "line_id").collect()]
        assert [got[r.query_id][k] for k in sorted(got[r.query_id])] == want


FUSED = "query_id bigint, line_id bigint, section_id bigint, line_hash bigint, file_path string, fused_score double, title string, reference string, segment bigint, is_pdf boolean"


def _fused(spark, rows):
    return spark.createDataFrame([(0, i, s, h, "f", float(x), "t", "r", 0, False) for i, s, h, x in rows], FUSED)


def test_groups(spark):
    many = grouping.group(_fused(spark, [(k, 1, 0, k) for k in range(25)]), grouping.SAME_SECTION).collect()
    assert len(many) == 1 and many[0].group_count == 25 and [s.line_id for s in many[0].siblings] == list(range(23, 13, -1)) and many[0].line_id == 24
    rows = [(k, k % 3, k % 2, k % 5) for k in range(20)]
    for mode in (grouping.SAME_SECTION, grouping.IDENTICAL_TEXT):
        assert sum(r.group_count for r in grouping.group(_fused(spark, rows), mode).collect()) == 20
    assert len(grouping.group(_fused(spark, rows), grouping.IDENTICAL_TEXT).collect()) == 11
    seen = [r.line_id for o in range(0, 24, 6) for r in grouping.page(_fused(spark, rows), o, 6).orderBy("position").collect()]
    assert sorted(seen) == list(range(20)) and seen[0] == 4


def test_duplicate_penalty(spark):
    got = fusion.with_duplicate_penalty(_fused(spark, [(1, 0, 7, 0.9), (2, 0, 7, 0.9), (3, 0, 0, 0.5), (4, 0, 0, 0.5)]), 0.1)
    assert {r.line_id: round(r.fused_score, 3) for r in got.collect()} == {1: 0.9, 2: 0.8, 3: 0.5, 4: 0.5}


# --- chunks, manifest, packing

BOOKS = "source_book_key string, title string, content_fingerprint bigint, is_pdf boolean, topics string, extra_facets array<string>"
LINES = "source_book_key string, ord int, line_id bigint, section_id bigint, text string, line_hash bigint, reference string, segment bigint"


def library(spark):
    books = spark.createDataFrame([("A", "Book A", 5, False, "/x/y/z", ["/author/1", "/author/2", "/era/1", "/base"]), ("B", "Book B", 0, True, "/w", ["/era/2"]), ("C", "Book C", 9, False, "/w", [])], BOOKS)
    lines = spark.createDataFrame([("A", 0, 1, 100, "the first line of book A is long enough", 11, "A1", 0), ("A", 1, 2, 100, "second one", 12, "A2", 1), ("A", 2, 3, 101, "the third line is in another section", 13, "A3", 2), ("B", 0, 501, 900, "the only line of book B, which is a PDF", 14, "B1", 0), ("C", 0, 900, 1, " \xa0 ", 0, "C1", 0)], LINES)
    return books, lines


def test_chunks(spark):
    books, lines = library(spark)
    got = {r.line_id: r for r in chunking.chunk_lines(books, lines).collect()}
    assert set(got) == {1, 2, 3, 501} and got[2].embedding_text == "the first line of book A is long enough second one" and got[2].source_doc_key == "A:2"
    short = spark.createDataFrame([("A", k, k, s, t, 0, "", k) for k, (s, t) in enumerate([(1, "x"), (1, "ab"), (2, "abcde"), (1, "\xa0\t"), (1, "fghij")])], LINES)
    assert {r.line_id: r.embedding_text for r in chunking.chunk_lines(books, short).collect()} == {2: "abcde", 4: "fghij"}


def test_index_life(spark, tmp_path):
    books, lines = library(spark)
    config = manifest_store.ManifestConfig("m", 64, H.signed(H.ChunkerConfig().identity))
    open_ = lambda **k: index_plan.SemanticIndex(spark, str(tmp_path / "i"), config, embedding.HashEmbedder(64), **k)
    i = open_()
    assert i.index_books(books, lines) == index_plan.Summary(2, 0, 1, 4)
    assert i.index_books(books, lines) == index_plan.Summary(0, 3, 0, 0)
    i = open_()
    assert (i.status().books, i.status().vectors, i.status().empty_books) == (3, 4, 1)
    changed = lines.withColumn("text", F.when(F.col("line_id") == 3, "the third line was changed here").otherwise(F.col("text")))
    assert i.index_books(books, changed) == index_plan.Summary(1, 2, 0, 3) and i.store.count() == 4
    d = i.diff_from_hashes(spark.createDataFrame([("A", 5), ("B", 0), ("D", 1)], "source_book_key string, hash bigint"))
    assert (d.new_books, d.changed_books, d.unverifiable_books, d.removed_books) == (["D"], [], ["B"], ["C"])
    assert i.remove_books(["B"]) == 1 and i.store.book_vector_count("B") == 0 and i.store.contains("x") is False
    with pytest.raises(ReadOnlyError, match="remove_books"):
        open_(read_only=True).remove_books(["A"])
    other = index_plan.SemanticIndex(spark, str(tmp_path / "i"), manifest_store.ManifestConfig("other", 64, 1), embedding.HashEmbedder(64))
    with pytest.raises(index_plan.IncompatibleIndexError):
        other.index_books(books, lines)
    d = other.diff_from_hashes(spark.createDataFrame([("A", 5), ("D", 1)], "source_book_key string, hash bigint"))
    assert d.model_mismatch and d.changed_books == ["A"] and d.new_books == ["D"]
    assert other.reset() == 3 and other.store.count() == 0 and not other.mismatches


def test_search_engine(spark, tmp_path):
    books, lines = library(spark)
    config = manifest_store.ManifestConfig("m", 64, H.signed(H.ChunkerConfig().identity))
    engine = search_plan.SearchEngine(spark, index_plan.SemanticIndex(spark, str(tmp_path / "i"), config, embedding.HashEmbedder(64)))
    engine.index_books(books, lines)
    lex = [{"line_id": r.line_id, "section_id": r.section_id, "line_hash": r.line_hash, "segment": r.segment, "title": "t", "reference": r.reference, "text": r.text, "is_pdf": False, "file_path": r.source_book_key, "bm25_score": 9.0 - r.ord} for r in lines.where("line_id < 3").collect()]
    P = search_plan.SearchParams
    r = engine.search("first line of book", lex, P(grouping=grouping.SAME_SECTION))
    assert r.search_mode == "Hybrid" and r.semantic_available and r.total_count == 4 and r.group_count == 3 and sum(x.merged_count for x in r.results) == 4
    assert engine.search("first line of book", lex, P(grouping=grouping.SAME_SECTION)).telemetry["cache_hit"]
    ids = [x.line_id for o in (0, 2, 4) for x in engine.search("first line of book", lex, P(limit=2, offset=o)).results]
    assert sorted(ids) == [1, 2, 3, 501]
    quoted = engine.search('"second one"', lex)
    assert quoted.search_mode == "Lexical Only" and not quoted.semantic_available and quoted.fallback_reason is None
    only = engine.search("first line", lex, P(force_mode="Semantic Only", filters=SearchFilters(facets=("/w",))))
    assert [x.line_id for x in only.results] == [501] and only.results[0].needs_hydration
    bare = search_plan.SearchEngine(spark)
    degraded = bare.search("first line of", lex)
    assert degraded.search_mode == "Lexical Only" and degraded.fallback_reason and len(degraded.results) == 2 and len(bare.query_cache) == 0
    assert bare.search("first line of", lex, P(force_mode="Semantic Only")).results == []
    s = engine.telemetry_snapshot()
    assert s.total_searches == 7 and s.cache_hits == 1 and s.strategy_distribution["SingleSource"] == 2
    engine.reset_telemetry()
    assert engine.telemetry_snapshot().total_searches == 0


def test_manifest_files(tmp_path):
    folder = str(tmp_path)
    assert manifest_store.load(folder) is None
    m = manifest_store.Manifest(manifest_store.ManifestConfig("m", 8, 1, model_checksum="a")).with_books([{"source_book_key": "A", "chunk_count": 1}])
    manifest_store.save(m, folder)
    assert manifest_store.load(folder).books["A"]["chunk_count"] == 1
    os.rename(f"{folder}/manifest.json", f"{folder}/manifest.json.previous")
    assert manifest_store.load(folder).books
    unknown, other = manifest_store.ManifestConfig("m", 8, 2), manifest_store.ManifestConfig("n", 9, 1, model_checksum="b")
    assert [f for f, *_ in m.mismatches(unknown)] == ["chunking_identity"] and not m.invalidates_vectors(unknown)
    assert [f for f, *_ in m.mismatches(other)] == ["embedding_model_id", "model_checksum", "embedding_dim"] and m.invalidates_vectors(other)
    (tmp_path / "manifest.json").write_text("{")
    with pytest.raises(manifest_store.ManifestError):
        manifest_store.load(folder)
    assert manifest_store.quarantine(folder, "bad") and manifest_store.load(folder).books


def test_vector_store(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "v"), 2, VECTORS)
    df = spark.createDataFrame(_store_rows(), VECTORS)
    assert s.count() == 0 and s.insert_batch(df) == 20 and s.insert_batch(df.limit(0)) == 0
    moved = df.where("line_id = 3").withColumn("source_book_key", F.lit("c"))
    assert s.insert_batch(moved) == 1 and s.count() == 20 and [r[0] for r in s.book_keys().collect()] == ["a", "b", "c"]
    with pytest.raises(StoreError):
        s.insert_batch(df.withColumn("vector", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")))
    assert s.count() == 20 and s.remove_by_book("b") == 10 and [r.line_id for r in s.search([1.0, 0.0], 2).collect()] == [1, 3]
    ro = ReadOnlyStore(s)
    assert ro.count() == 10
    for name in ("insert_batch", "remove_by_book", "clear"):
        with pytest.raises(ReadOnlyError, match=name):
            getattr(ro, name)
    assert s.clear() == 10 and s.count() == 0


def test_snapshot(spark, tmp_path):
    path, df = str(tmp_path / "s"), spark.createDataFrame(_store_rows(), VECTORS)
    assert snapshot.read(spark, path, 2) is None
    snapshot.write(df, path, 2)
    assert sorted(map(repr, snapshot.read(spark, path, 2).collect())) == sorted(map(repr, df.collect()))
    snapshot.write(df.limit(3), path, 2)
    assert snapshot.read(spark, path, 2).count() == 3
    os.rename(path, f"{path}.previous")
    assert snapshot.read(spark, path, 2).count() == 3
    header = json.load(open(f"{path}/header.json"))
    json.dump(header | {"digest": "1"}, open(f"{path}/header.json", "w"))
    with pytest.raises(snapshot.CorruptedError):
        snapshot.read(spark, path, 2)
    os.remove(f"{path}/header.json")
    with pytest.raises(snapshot.CorruptedError):
        snapshot.read(spark, path, 2)


def corpus_lines(spark):
    return spark.createDataFrame([(k, "b", "T", f"r{k}", k // 2, k, False, 0, 7, ["/a"], f"text of line {k}") for k in range(1, 7)], corpus.CORPUS_SCHEMA)


def test_corpus_and_packing(spark, tmp_path):
    import hashlib

    lines = corpus_lines(spark)
    ident = corpus.CorpusIdentity("c", "1", 1, 1)
    a, b = str(tmp_path / "id.json"), str(tmp_path / "lines")
    corpus.write_corpus(lines, ident, a, b)
    c = corpus.JsonCorpus(spark, a, b)
    assert c.identity() == ident and c.lines().count() == 6 and c.line(2).count() == 1
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    (tmp_path / "v.f32").write_bytes(b"".join(struct.pack("<2f", k, 1.0) for k in range(1, 7)))
    (tmp_path / "r.jsonl").write_text("\n\n".join(json.dumps({"line_id": k, "source_line_sha256": sha(f"text of line {k}"), "embedding_text_sha256": sha("x")}) for k in range(1, 7)))
    inputs = corpus.read_vector_inputs(spark, str(tmp_path / "v.f32"), str(tmp_path / "r.jsonl"), 2)
    assert {r.line_id: r.vector for r in inputs.collect()} == {k: [k, 1.0] for k in range(1, 7)}
    records = packer.pack(inputs, c.lines(), 2, 99)
    packer.validate(records, c.lines(), 99)
    snapshot.write(records, str(tmp_path / "s"), 2)
    packer.validate(snapshot.read(spark, str(tmp_path / "s"), 2), c.lines(), 99)
    for bad, why in ((records.withColumn("title", F.lit("no")), "title"), (records.withColumn("chunk_hash", F.lit("Z")), "chunk_hash"), (records.withColumn("line_id", F.col("line_id") + 100), "not_in_corpus")):
        with pytest.raises(packer.PackError, match=f"line .*: {why}"):
            packer.validate(bad, c.lines(), 99)
    with pytest.raises(packer.PackError, match="1 missing .first 6."):
        packer.pack(inputs.where("line_id < 6"), c.lines(), 2, 99)
    with pytest.raises(packer.PackError, match="line 1: text_mismatch"):
        packer.pack(inputs, c.lines().withColumn("text", F.lit("?")), 2, 99)
    for dim, error in ((5, "whole number"), (4, "6 records and 3 vectors")):
        with pytest.raises(corpus.SourceError, match=error):
            corpus.read_vector_inputs(spark, str(tmp_path / "v.f32"), str(tmp_path / "r.jsonl"), dim)
    corpus.write_corpus(lines.unionByName(lines.limit(1)), ident, a, str(tmp_path / "twice"))
    with pytest.raises(corpus.SourceError, match="more than once"):
        corpus.JsonCorpus(spark, a, str(tmp_path / "twice"))


def test_records_name_every_field():
    names = {c.split()[0] for c in index_plan.RECORD.split(", ")}
    assert names - {"vector", "chunk_hash"} == set(packer.FIELDS)


# --- artifacts


def version(**k):
    base = {f: "x" for f in ("corpus_id", "library_version", "model_id", "model_quantization", "embedding_backend", "pooling", "store_backend_id", "vector_precision")}
    base |= {f: 1 for f in ("lexical_schema_version", "document_id_scheme_version", "embedding_dim", "max_tokens", "embedding_text_version", "normalization_version", "chunking_identity", "store_format_version")}
    return artifact.IndexVersion(**(base | {"model_checksum": "a" * 64} | k))


def package(root, data=b"payload"):
    os.makedirs(root)
    with open(f"{root}/vectors.bin", "wb") as f:
        f.write(data)
    p = artifact.Package.describe(str(root), version(), 1, 2, "now")
    p.write(str(root))
    return p


def test_every_identity_field_counts():
    good = version()
    good.require_complete()
    for f in artifact.fields(good):
        empty = 0 if isinstance(getattr(good, f.name), int) else " "
        with pytest.raises(artifact.IncompleteIdentity, match=f.name):
            version(**{f.name: empty}).require_complete()
        other = 2 if isinstance(getattr(good, f.name), int) else "b" * 64
        assert [x[0] for x in good.mismatches(version(**{f.name: other}))] == [f.name]
    with pytest.raises(artifact.IncompleteIdentity):
        version(corpus_id="a\nb").require_complete()


@pytest.mark.parametrize("name", ["", ".", "..", ".x", "x.", "a/b", "a\\b", "a:b", "a b", "é", "x" * 256, "Manifest.JSON", "payloads.json", "nul.bin", "COM1"])
def test_payload_names(name):
    with pytest.raises(artifact.UnsafePayloadName):
        artifact.check_payload_name(name)


def test_install(tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    p = package(source)
    assert p.digest() == artifact.Package.read(source).digest()
    v = artifact.install(source, target, version(), p.digest())
    assert not v.full and artifact.verify_for_install(target, version()).full
    with pytest.raises(artifact.ArtifactError):
        artifact.VerifiedPackage(target, p, True, None)
    with pytest.raises(artifact.WrongArtifact, match="corpus_id"):
        artifact.verify_for_open(target, version(corpus_id="other"))
    with pytest.raises(artifact.UnpublishedArtifact):
        artifact.verify_for_open(target, version(), "0" * 64)
    with open(f"{target}/vectors.bin", "wb") as f:
        f.write(b"PAYLOAD")
    artifact.verify_for_open(target, version())
    with pytest.raises(artifact.DamagedArtifact, match="digest"):
        artifact.verify_for_install(target, version())
    with open(f"{target}/vectors.bin", "wb") as f:
        f.write(b"short")
    with pytest.raises(artifact.DamagedArtifact, match="bytes"):
        artifact.verify_for_open(target, version())
    os.remove(f"{target}/vectors.bin")
    with pytest.raises(artifact.DamagedArtifact, match="missing"):
        artifact.verify_for_open(target, version())
    os.rename(target, f"{target}.previous")
    os.makedirs(f"{target}.staged")
    assert artifact.recover_interrupted_install(target) == "restored" and not os.path.exists(f"{target}.staged")
    assert artifact.recover_interrupted_install(target) == "nothing"


def test_a_failed_install_leaves_the_old_one(tmp_path, monkeypatch):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    package(source)
    artifact.install(source, target, version())
    real, calls = os.rename, []

    def broken(a, b):
        calls.append((a, b))
        if len(calls) == 2:
            raise OSError("disk")
        return real(a, b)

    monkeypatch.setattr(artifact.os, "rename", broken)
    with pytest.raises(OSError):
        artifact.install(source, target, version())
    monkeypatch.undo()
    artifact.verify_for_install(target, version())


def test_gguf(tmp_path):
    def file(version=3, alignment=32, offset=0, data=b"\0" * 64, dims=(4,)):
        key = b"general.alignment"
        out = b"GGUF" + struct.pack("<IQQ", version, 1, 2) + struct.pack("<Q", len(key)) + key + struct.pack("<II", 4, alignment)
        out += struct.pack("<Q", 1) + b"k" + struct.pack("<IIQ", 9, 8, 1) + struct.pack("<Q", 2) + b"hi"
        out += struct.pack("<Q", 1) + b"t" + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", 0, offset)
        out += b"\0" * (-len(out) % alignment) + data
        p = tmp_path / "m.gguf"
        p.write_bytes(out)
        return str(p)

    import hashlib

    path = file()
    assert gguf.validate(path) == hashlib.sha256(open(path, "rb").read()).hexdigest()
    for bad in (dict(version=1), dict(alignment=12), dict(offset=3), dict(data=b""), dict(dims=(1 << 20, 1 << 20)), dict(dims=(1,) * 5)):
        with pytest.raises(gguf.GgufError):
            gguf.validate(file(**bad))


# --- caches, telemetry, embedders


def test_caches():
    now = [0.0]
    c = caches.QueryCache(2, 300, lambda: now[0])
    c.insert(b"a", 1), c.insert(b"b", 2), c.get(b"a"), c.insert(b"c", 3)
    assert (c.get(b"a"), c.get(b"b"), c.get(b"c"), c.evictions) == (1, None, 3, 1)
    now[0] = 301
    assert c.get(b"a") is None
    c.insert(b"d", 4)
    c.invalidate()
    assert c.get(b"d") is None
    c.insert(b"e", 5, 0)
    assert c.get(b"e") is None
    assert caches.QueryCache.key("a", b"bc", "m", None, 1, 2) != caches.QueryCache.key("ab", b"c", "m", None, 1, 2)
    e = caches.EmbeddingCache(2)
    e.insert("a", 1), e.insert("b", 2), e.get("a"), e.insert("c", 3)
    assert (e.get("a"), e.get("b"), e.get("c")) == (1, None, 3)


def test_percentiles(spark):
    df = spark.createDataFrame([("b", k) for k in range(10, 1001, 10)], "benchmark string, latency_us bigint")
    r = telemetry.latency_summary(df).first()
    assert (r.p50_us, r.p95_us, r.p99_us, r.min_us, r.max_us, r.mean_us, r.upper_median_us, r.iterations) == (510, 950, 990, 10, 1000, 505, 510, 100)


def test_telemetry(spark):
    rows = [("RRF", 100, True, True, 5), ("RRF", 10, True, True, None), ("Weighted", 10, True, False, None)]
    r = telemetry.snapshot(spark.createDataFrame(rows, "fusion_strategy string, latency_ms bigint, cache_lookup boolean, cache_hit boolean, embedding_latency_ms bigint")).first()
    assert (r.avg_latency_ms, r.embedding_calls, r.strategy_distribution) == (40, 1, {"RRF": 2, "Weighted": 1}) and r.cache_hit_rate == pytest.approx(2 / 3)


def test_embedders():
    with pytest.raises(embedding.EmbeddingError):
        embedding.select([])
    with pytest.raises(embedding.EmbeddingError):
        embedding.select([embedding.HashEmbedder(4)])
    assert embedding.select([embedding.HashEmbedder(4)], allow_mock=True).dim == 4
    for bad in ([[0.0, 0.0]], [[math.nan, 1.0]], [[1.0]], [[1.0, 1.0], [1.0, 1.0]]):
        with pytest.raises(embedding.EmbeddingError):
            embedding.checked(bad, 1, 2)


def test_lifecycle_differences(spark):
    a = spark.createDataFrame([("A", "1"), ("A", "2")], "source_book_key string, semantic_id string")
    b = spark.createDataFrame([("A", "2"), ("B", "3")], "source_book_key string, semantic_id string")
    assert {(r.semantic_id, r.side) for r in lifecycle.book_index_differences(a, b).collect()} == {("1", "stored"), ("3", "rebuilt")}
    m = spark.createDataFrame([("A", 2), ("B", 0)], "source_book_key string, chunk_count bigint")
    assert lifecycle.vectors_against_manifest(a, m).first().agree


def test_stream(spark, tmp_path):
    from fathom.streaming.ingest import index_stream

    books, lines = library(spark)
    lines.write.parquet(f"{tmp_path}/in/1")
    i = index_plan.SemanticIndex(spark, f"{tmp_path}/i", manifest_store.ManifestConfig("m", 16, H.signed(H.ChunkerConfig().identity)), embedding.HashEmbedder(16))
    q = index_stream(spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in/*"), books, i, f"{tmp_path}/c")
    q.awaitTermination(120)
    assert i.status().vectors == 4


def test_command_line(spark, tmp_path, capsys):
    from fathom.__main__ import main

    assert main(["version"]) == 0
    (tmp_path / "b.txt").write_text("the first line is here to be found\nthe second line is another one\n")
    index = ["--index", str(tmp_path / "i"), "--hash-embedder", "--dim", "32"]
    assert main(["index-text", *index, str(tmp_path / "b.txt")]) == 0
    assert main(["search", *index, "the first line is here"]) == 0
    assert main(["status", *index]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines()[1:]]
    assert out[0]["indexed_chunks"] == 2 and len(out[1]["results"]) == 2 and out[2]["vectors"] == 2
