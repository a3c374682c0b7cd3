"""What must hold at sizes that the tables of the other tests don't have."""

import hashlib
import time
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import adapter as A
from fathom import queries as Q
from fathom.functions import hashing as H
from fathom.functions import text as T
from fathom.functions import vectors as V
from fathom.operators import fusion, vector_search
from fathom.plans import profiles


def test_trim_looks_at_the_ends_only(spark):
    x = f"a{' ' * 200_000}b"
    df = spark.createDataFrame([(f"{T.BLANKS}{x}{T.BLANKS}",), (T.BLANKS,), ("",), (None,), (" \x1c \n",)], "x string")
    began = time.monotonic()
    assert [r[0] for r in df.select(T.unicode_trim("x")).collect()] == [x, "", "", None, "\x1c"]
    assert time.monotonic() - began < 10
    assert [r[0] for r in df.select(F.regexp_replace(F.lit(T.BLANKS), T.WHITE, "")).collect()] == [""] * 5


def test_embedding_of_many_texts_equals_one_word_at_a_time(monkeypatch):
    texts = ["", " \t", "a a a", "hello world", " ".join(f"w{i % 37} é{i}" for i in range(3000)), "x"] * 3
    monkeypatch.setattr(V, "EMBED_CHARS", 500)
    monkeypatch.setattr(V, "KNOWN_WORDS", 100)
    for dim in (0, 1, 7, 64):
        want = np.zeros((len(texts), max(1, dim)), np.float32)
        for row, t in zip(want, texts):
            for k, w in enumerate(t.split(), 1):
                h = hashlib.sha256(w.encode()).digest()
                row[(h[0] | h[1] << 8) % len(row)] += np.float32(-1.0 if h[4] & 1 else 1.0) / np.float32(k)
                row[(h[2] | h[3] << 8) % len(row)] += np.float32(-0.5 if h[5] & 1 else 0.5) / np.float32(k)
        got = V.hash_embeddings(texts, dim)
        assert got.dtype == np.float32 and (got == want).all()
    assert V.hash_embeddings([], 4).shape == (0, 4)


def test_hashing_needs_little_more_than_the_bytes():
    items = [bytes([i]) * (1 << 16) for i in range(64)]
    tracemalloc.start()
    got = H.fnv1a_many(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 64 * (1 << 16)
    assert got[3] == H.fnv1a(items[3]) and got[63] == H.fnv1a(items[63])


def test_fingerprints_of_books_hashed_in_parts(spark, monkeypatch):
    books = spark.createDataFrame([(f"b{i}", f"t{i}", "/x", i % 2 == 0, ["/b", "/a"]) for i in range(7)], "source_book_key string, title string, topics string, is_pdf boolean, extra_facets array<string>")
    lines = spark.createDataFrame([(f"b{i}", o, 10 * i + o, 0, o, -i, None if o == 1 else f"r{o}", None if o == 2 else f"é{o}") for i in range(6) for o in reversed(range(i))], "source_book_key string, ord int, line_id bigint, section_id bigint, segment bigint, line_hash bigint, reference string, text string")
    whole = dict(H.line_fingerprints(books, lines).collect())
    monkeypatch.setattr(H, "BOOKS_AT_ONCE", 2)
    monkeypatch.setattr(H, "HASHED_BYTES", 10)
    assert len(whole) == 7 and dict(H.line_fingerprints(books.coalesce(1), lines).collect()) == whole
    le = lambda x: (x % 2**64).to_bytes(8, "little")
    field = lambda x: le(len(x)) + x
    body = b"".join(field(le(n)) for n in (20, 0, 0, -2)) + field(b"r0") + field("é0".encode()) + b"".join(field(le(n)) for n in (21, 0, 1, -2)) + field(b"") + field("é1".encode())
    assert H.unsigned(whole["b2"]) == H.fnv1a(field(b"t2") + field(b"/x") + field(b"\1") + field(b"/a") + field(b"/b") + field(le(2)) + body)


def test_vectors_stream_past_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 16)
    r = np.random.RandomState(0)
    x = r.randint(-2, 3, (300, 4)).astype(np.float32)  # many equal cosines, some without a direction
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (301, [1.0]), (302, [1.0, float("nan"), 0.0, 0.0])]
    for kind in ("float", "double"):
        v = spark.createDataFrame(rows, f"line_id bigint, vector array<{kind}>").repartition(3)
        q = v.where("line_id < 40 or line_id >= 300").select((F.col("line_id") % 39).alias("query_id"), "vector")  # two vectors are one query
        got = vector_search.search_all(v, q, 5)
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        found = {}
        for g in got.collect():
            found.setdefault(g.query_id, []).append((g["rank"], -g.similarity, g.line_id))
        length = np.linalg.norm(x.astype(float), axis=1)
        ok = np.flatnonzero(length > 0)
        unit = x[ok].astype(float) / length[ok, None]
        want = {}
        for i in range(40):
            if length[i]:
                want.setdefault(i % 39, []).extend(zip(-np.round(unit @ (x[i] / length[i]), 9), ok))
        assert set(found) == set(want)
        for i, all_ in want.items():
            assert [(-s, n) for _, s, n in sorted(found[i])] == [(-s, n) for s, n in sorted(all_)[:5]]


def _tables(tmp_path, lines, turns, shift=0):
    duckdb.sql(f"copy (select i + {shift} as vec_id, [i % 7, 1, i % 3]::FLOAT[] as embedding, (i % 5)::INTEGER as label from range({lines}) r(i)) to '{tmp_path}/embeddings.parquet'")
    duckdb.sql(f"copy (select i + {shift} as doc_id, 'Text ' || i || ' wonderful \"things\" ' || (i % 11) || 'abcdefg' as text, 'en' as lang, 's' || i % 2 as source from range({lines - 5}) r(i)) to '{tmp_path}/documents.parquet'")
    rows = ", ".join(f"({c + shift}, {t}, '{x}')" for c, t, x in turns)
    duckdb.sql(f"copy (select c::BIGINT as conv_id, t::BIGINT as turn, x as text from (values {rows}) v(c, t, x)) to '{tmp_path}/conversations.parquet'")


TURNS = [(0, 0, "wonderful 3abcdefg"), (0, 1, "say \"ul \" or \"nothing\" onderful"), (0, 100, "wonderful"), (1, 0, "a Text-like 10abcdefg wonderf"), (2, 7, ""), (699, 3, "abcdefg")]


@pytest.mark.parametrize("lines, shift", [(700, 0), (40, 0), (700, -350)])
def test_lists_of_candidates_equal_the_product(spark, tmp_path, lines, shift):
    """Also where two turns are one query, lines are few, or ids are negative; turn 100 of a conversation is turn 0 of the next."""
    _tables(tmp_path, lines, TURNS, shift)
    con = duckdb.connect()
    for t in ("embeddings", "documents", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert A.lexical_lists(spark, str(tmp_path), 20).count() <= 20 * A.CYCLE
    for name in ("norm_bm25", "section_coverage", "rare_bonus", "phrase_bonus", "norm_semantic_threshold", "vector_topk_filtered"):
        got = Q.QUERIES[name](spark, str(tmp_path))
        names = got.columns
        want = con.sql(Q.ORACLES[name]).select(*names).fetchall()
        plain = lambda rows: sorted(tuple(round(float(x), 6) for x in r) for r in rows)
        assert plain(got.collect()) == plain(want), name


def test_finder_equals_contains():
    texts = ["onderful wonderful", "", "wonder ful", "a wonderfully", "abcdef"] * 2
    finder = fusion.Finder(texts)
    for x in ("wonderful", "onderf", "wonder ful", "der", "a wonder", "abcdef", "bcdefg", "nderful wonde"):
        assert finder.parts([x]).tolist() == [float(x in t) for t in texts]
    assert finder.parts(["wonderful", "nothing here", "wonderful", "abcdef"])[:5].tolist() == [0.5, 0, 0, 0.5, 0.25]


def test_fusing_sorts_by_query_once_and_keeps_the_best_of_repeated_lines(spark):
    lex = spark.createDataFrame([(1, r, line, 0, 0, 0, "t", "r", "text", False, "f", s) for r, line, s in ((1, 5, 9.0), (2, 5, 30.0), (3, 6, 30.0), (4, 5, 30.0))], "query_id bigint, rank int, line_id bigint, section_id bigint, line_hash bigint, segment bigint, title string, reference string, text string, is_pdf boolean, file_path string, bm25_score double")
    sem = spark.createDataFrame([(1, r, s, line, 0, 0, 0, "t", "r", False, "f", []) for r, line, s in ((1, 6, 0.5), (2, 6, 0.9), (3, 7, 0.1))], "query_id bigint, rank int, similarity double, line_id bigint, section_id bigint, line_hash bigint, segment bigint, title string, reference string, is_pdf boolean, source_book_key string, facets array<string>")
    queries = spark.createDataFrame([(1, 0.5, [], [])], "query_id bigint, alpha double, quoted_phrases array<string>, rare_tokens array<string>")
    out = fusion.fuse(lex, sem, queries, profiles.BALANCED)
    got = {r.line_id: (r.source, r.raw_bm25_score, r.raw_semantic_score, round(r.fused_score, 6), r.text) for r in out.collect()}
    assert got == {5: ("Lexical", 30.0, None, 0.375, "text"), 6: ("Both", 30.0, 0.9, 0.95, "text"), 7: ("Semantic", None, 0.1, 0.275, "")}
    ranks = {r.line_id: round(r.fused_score, 9) for r in fusion.fuse(lex, sem, queries, profiles.FAST).collect()}
    assert ranks == {5: round(1 / 61, 9), 6: round(1 / 62 + 1 / 61, 9), 7: round(1 / 62, 9)}
    plan = confidence_plan = fusion.confidence(out)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") + plan.count("Exchange hashpartitioning(line_id") == plan.count("Exchange hashpartitioning(query_id") <= 3, confidence_plan


def test_parts_of_queries_are_not_merged(spark):
    """Few ids become k rows each; in one part they would be the work of one core."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = A.lexical_candidates(spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() == n
