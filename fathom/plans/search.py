"""One search request: resolved on the driver, answered by one DataFrame plan, and cached."""

from __future__ import annotations

import dataclasses
import re
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashing import length_prefixed_sha256
from ..operators import fusion, grouping, telemetry
from ..operators.filters import SearchFilters
from .caches import EmbeddingCache, QueryCache
from .embedding import EmbeddingError, checked
from .index import SemanticIndex, Status
from .profiles import BALANCED, HYBRID, LEXICAL_ONLY, PROFILES, SEMANTIC_ONLY, FeatureFlags, actual_mode, effective_alpha

LEXICAL = "query_id bigint, rank bigint, line_id bigint, section_id bigint, line_hash bigint, segment bigint, title string, reference string, text string, is_pdf boolean, file_path string, bm25_score double"
MIN_CACHEABLE = 2
_MARKS = re.compile("[֑-ׇֽֿׁׂׅׄ]")
TELEMETRY = "query_type string, search_mode string, fusion_strategy string, alpha double, lexical_candidates bigint, semantic_candidates bigint, fused_candidates bigint, cache_lookup boolean, cache_hit boolean, latency_ms bigint, embedding_latency_ms bigint, fusion_latency_ms bigint, confidence double, profile string"


def normalize(q: str) -> str:
    """The twin of text.normalize for one string."""
    return " ".join(_MARKS.sub("", q).translate({0x5F3: "'", 0x5F4: '"'}).split())


@dataclass(frozen=True)
class Features:
    token_count: int
    has_quoted_phrase: bool
    estimated_type: str
    rare_tokens: tuple[str, ...]
    quoted_phrases: tuple[str, ...]

    @property
    def alpha(self) -> float:
        return 1.0 if self.estimated_type == T.EXACT and self.has_quoted_phrase else T.ALPHA[self.estimated_type]


def analyze(q: str, requires_pair: bool = False) -> Features:
    """The twin of text.query_features for one string."""
    w = q.split()
    parts = q.split('"')
    phrases = tuple(p for p in (x.strip() for x in parts[1 : len(parts) - 1 : 2]) if p)
    quoted = bool(phrases) if requires_pair else '"' in q
    digit = any(c in "0123456789" for t in w for c in t)
    kind = T.UNKNOWN if not w else T.EXACT if quoted else (T.EXACT if digit else T.SHORT) if len(w) <= 2 else T.CONCEPTUAL if len(w) >= 5 else T.MIXED
    return Features(len(w), quoted, kind, tuple(t for t in w if len(t) > T.RARE_CHARS), phrases)


@dataclass(frozen=True)
class SearchParams:
    limit: int = 20
    offset: int = 0
    filters: SearchFilters | None = None
    grouping: str | None = None
    force_mode: str | None = None
    profile: str = BALANCED.name
    flags: FeatureFlags = FeatureFlags()
    telemetry_per_query: bool = True
    query_cache_capacity: int = 100
    quote_requires_pair: bool = False


@dataclass(frozen=True)
class SearchResult:
    results: list[Row]
    total_count: int
    group_count: int | None
    search_mode: str
    semantic_available: bool
    fallback_reason: str | None
    latency_ms: int
    confidence: float | None
    profile: str
    telemetry: dict | None = field(default=None)


class SearchEngine:
    def __init__(self, spark: SparkSession, index: SemanticIndex | None = None):
        self.spark, self.index = spark, index
        self.query_cache, self.embedding_cache = QueryCache(), EmbeddingCache()
        self._records: list[dict] = []

    # --- the search

    def _query_vector(self, q: str, cached: bool) -> tuple[np.ndarray, int | None]:
        if cached and (v := self.embedding_cache.get(q)) is not None:
            return v, None
        if self.index.embedder is None:
            raise EmbeddingError("no embedding backend is configured")
        began = time.monotonic()
        v = checked(self.index.embedder.embed([q]), 1, self.index.embedder.dim)[0]
        if cached:
            self.embedding_cache.insert(q, v)
        return v, int(1000 * (time.monotonic() - began))

    def search(self, query: str, lexical: list[dict] | list[Row] = (), params: SearchParams = SearchParams()) -> SearchResult:
        """query against the index and the caller's lexical candidates (fields of LEXICAL without query_id; rank is their order)."""
        began = time.monotonic()
        profile = params.flags.resolve(PROFILES[params.profile])
        requested = params.force_mode or HYBRID
        q = normalize(query)
        features = analyze(q, params.quote_requires_pair)
        alpha = min(1.0, max(0.0, features.alpha if profile.alpha_override is None else profile.alpha_override))
        rows = [r.asDict() if isinstance(r, Row) else dict(r) for r in lexical]
        record = {"query_type": features.estimated_type, "search_mode": requested, "fusion_strategy": profile.strategy, "alpha": alpha, "lexical_candidates": len(rows), "semantic_candidates": 0, "fused_candidates": 0, "cache_lookup": False, "cache_hit": False, "latency_ms": 0, "embedding_latency_ms": None, "fusion_latency_ms": 0, "confidence": None, "profile": profile.name}
        cacheable = profile.query_cache_enabled and len(q) >= MIN_CACHEABLE
        record["cache_lookup"] = cacheable
        key = QueryCache.key(query, length_prefixed_sha256(repr(params).encode(), *(repr(sorted(r.items())).encode() for r in rows)), requested, params.grouping, params.limit, params.offset)
        if cacheable and (hit := self.query_cache.get(key)) is not None:
            ms = int(1000 * (time.monotonic() - began))
            record |= {"cache_hit": True, "latency_ms": ms, **{k: hit.telemetry[k] for k in ("search_mode", "fusion_strategy", "semantic_candidates", "fused_candidates", "confidence")}}
            self._record(record, profile.telemetry_enabled)
            return dataclasses.replace(hit, latency_ms=ms, telemetry=record if profile.telemetry_enabled and params.telemetry_per_query else None)

        failure, semantic, ran = None, None, False
        if requested != LEXICAL_ONLY and not (requested == HYBRID and alpha >= 1.0):
            try:
                if self.index is None:
                    raise EmbeddingError("no semantic index is configured")
                vector, record["embedding_latency_ms"] = self._query_vector(q, profile.embedding_cache_enabled)
                k = grouping.candidate_window(params.limit, params.offset, profile.candidate_window_multiplier)
                # the candidates of one query are few (MAX_WINDOW at most): they are fetched once, and all that follows works on them
                found = self.index.store.search([float(x) for x in vector], k, params.filters).drop("vector")
                semantic = self.spark.createDataFrame(rows_found := found.collect(), found.schema)
                record["semantic_candidates"] = len(rows_found)
                ran = True
            except (EmbeddingError, ValueError) as e:
                failure = str(e)
        mode = actual_mode(requested, ran)
        weight = effective_alpha(mode, alpha)
        fused = self._fuse(rows if mode != SEMANTIC_ONLY else [], semantic, features, weight, profile, mode, params)
        fused_at = time.monotonic()
        fused = self.spark.createDataFrame(merged := fused.collect(), fused.schema)
        scores = [r.fused_score for r in sorted(merged, key=lambda r: (-r.fused_score, r.line_id))]
        groups = None
        page = fused
        if params.grouping:
            page = grouping.group(fused, params.grouping).cache()
            groups = page.count()
        else:
            page = page.withColumns({"siblings": F.array().cast("array<string>"), "group_count": F.lit(1)})
        items = grouping.result_items(grouping.page(page, params.offset, params.limit)).orderBy("position").collect()
        page.unpersist()
        c = None
        if len(scores) > 1 and scores[0] > 0:
            c = min(1.0, max(0.0, (scores[0] - scores[1]) / max(scores[0], 1e-6)))
        ms = int(1000 * (time.monotonic() - began))
        record |= {"search_mode": mode, "alpha": weight, "fused_candidates": len(scores), "latency_ms": ms, "fusion_latency_ms": int(1000 * (time.monotonic() - fused_at)), "confidence": c}
        if mode != HYBRID:
            record["fusion_strategy"] = "SingleSource"
        self._record(record, profile.telemetry_enabled)
        result = SearchResult(items, len(scores), groups, mode, ran, failure, ms, c, profile.name, record)
        if cacheable and failure is None:  # a degraded result isn't kept
            self.query_cache.insert(key, result, params.query_cache_capacity)
        return result if profile.telemetry_enabled and params.telemetry_per_query else dataclasses.replace(result, telemetry=None)

    def _fuse(self, rows, semantic, features: Features, alpha: float, profile, mode: str, params: SearchParams) -> DataFrame:
        names = [c.split()[0] for c in LEXICAL.split(", ")]
        lex = self.spark.createDataFrame([tuple(({"query_id": 0, "rank": k} | r).get(n) for n in names) for k, r in enumerate(rows)], LEXICAL)
        if semantic is None:
            semantic = self.spark.createDataFrame([], "semantic_id string, source_book_key string, line_id bigint, section_id bigint, line_hash bigint, reference string, segment bigint, is_pdf boolean, title string, facets array<string>, similarity double")
        from pyspark.sql import Window

        sem = semantic.withColumn("query_id", F.lit(0).cast("bigint")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "semantic_id")))
        queries = self.spark.createDataFrame([(0, alpha, list(features.quoted_phrases), list(features.rare_tokens))], "query_id bigint, alpha double, quoted_phrases array<string>, rare_tokens array<string>")
        facets = (params.filters.facets or ()) if params.filters else ()
        return fusion.fuse(lex, sem, queries, profile, mode, tuple(facets))

    # --- telemetry and the rest of the surface

    def _record(self, record: dict, enabled: bool) -> None:
        if enabled:
            self._records.append(dict(record))

    def telemetry_table(self) -> DataFrame:
        names = [c.split()[0] for c in TELEMETRY.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self._records], TELEMETRY)

    def telemetry_snapshot(self) -> Row:
        return telemetry.snapshot(self.telemetry_table()).first()

    def reset_telemetry(self) -> None:
        self._records.clear()

    def clear_query_cache(self) -> None:
        self.query_cache.clear()

    def index_books(self, books: DataFrame, lines: DataFrame):
        out = self.index.index_books(books, lines)
        self.query_cache.invalidate()
        return out

    def remove_books(self, keys: list[str]) -> int:
        n = self.index.remove_books(keys)
        self.query_cache.invalidate()
        return n

    def reset_index(self) -> int:
        n = self.index.reset()
        self.query_cache.invalidate()
        return n

    def status(self) -> Status:
        return self.index.status() if self.index else Status(False)
