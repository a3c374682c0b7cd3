"""Merging lexical and semantic candidates, and the ranking of the merged list. All of it is per query_id, for any number of queries.

lexical: query_id, rank, line_id, section_id, line_hash, segment, title, reference, text, is_pdf, file_path, bm25_score. Without text, all
is to be hydrated, and for the bonuses it has in its place text_parts: for each row that queries has of a query (nth, from 0) the parts
of its phrases and of its rare tokens that the text has.
semantic: query_id, rank, similarity, line_id, section_id, line_hash, segment, title, reference, is_pdf, source_book_key, facets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.facets import dimension_of, matches_exactly
from ..plans.profiles import HYBRID, RankingProfile

SATURATION = 10.0
PRIMARY_WORDS = ('תנ"ך', "תורה", "משנה", "תלמוד", "tanach", "mishna", "talmud")
PRIMARY_BONUS, ERA_BONUS, CATEGORY_BONUS = 0.03, 0.02, 0.02
LEXICAL, SEMANTIC, BOTH = "Lexical", "Semantic", "Both"
SIBLINGS = "title", "reference", "text", "section_id", "line_hash", "segment", "is_pdf", "file_path"


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize_bm25(x: Column, k: float = SATURATION) -> Column:
    """x / (k + x); 0 for what isn't positive, 1 for infinity."""
    return F.when(x.isNull() | F.isnan(x) | (x <= 0), 0.0).when(x == float("inf"), 1.0).otherwise(clamp(x / (x + k)))


def normalize_bm25_adaptive(x: Column, window, k: float = SATURATION) -> Column:
    """Min-max over the window's positive scores if the largest exceeds 2 k and they differ, else normalize_bm25."""
    positive = F.when(~F.isnan(x) & (x > 0), x)
    high, low = F.max(positive).over(window), F.min(positive).over(window)
    spread = F.when(positive.isNull(), 0.0).otherwise(clamp((x - low) / (high - low)))
    return F.when((high > 2 * k) & (high > low), spread).otherwise(normalize_bm25(x, k))


def normalize_semantic(x: Column) -> Column:
    """A cosine as a number from 0 to 1."""
    return F.when(F.isnan(x), 0.0).otherwise(clamp((x + 1) / 2))


def thresholded(x: Column, threshold: float | Column) -> Column:
    return F.when(x < threshold, 0.0).otherwise(x)


def source_of(lexical: Column, semantic: Column) -> Column:
    return F.when(lexical & semantic, BOTH).when(lexical, LEXICAL).otherwise(SEMANTIC)


def dedup_best(df: DataFrame, score: str) -> DataFrame:
    """One row for each query and line: of the best score, and of these of the first rank."""
    w = Window.partitionBy("query_id", "line_id").orderBy(F.desc(score), "rank")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _merged(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    return lexical.select("query_id", "line_id", F.col("score").alias("lex")).join(semantic.select("query_id", "line_id", F.col("score").alias("sem")), ["query_id", "line_id"], "full_outer")


def fuse_weighted(lexical: DataFrame, semantic: DataFrame, alpha: float | Column) -> DataFrame:
    """query_id, line_id, score and source of the union of two lists (query_id, line_id, score); a missing side counts 0."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    score = a * F.coalesce("lex", F.lit(0.0)) + (1 - a) * F.coalesce("sem", F.lit(0.0))
    return _merged(lexical, semantic).select("query_id", "line_id", score.alias("score"), source_of(F.col("lex").isNotNull(), F.col("sem").isNotNull()).alias("source"))


def fuse_rrf(lexical: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """As fuse_weighted, by the sum of 1 / (k + rank); the lists have their ranks, from 1, as score."""
    k = max(1, k)
    part = lambda c: F.coalesce(1 / (F.col(c) + k), F.lit(0.0))
    return _merged(lexical, semantic).select("query_id", "line_id", (part("lex") + part("sem")).alias("score"), source_of(F.col("lex").isNotNull(), F.col("sem").isNotNull()).alias("source"))


def _part_matched(text: Column, wanted: Column) -> Column:
    n = F.size(wanted)
    hits = F.size(F.filter(wanted, lambda w: F.contains(F.coalesce(text, F.lit("")), w)))
    return F.when(n > 0, hits / n).otherwise(0.0)


class Finder:
    """Which of some texts contain a string; for many strings. One of GRAM characters or more without white space, as rare tokens are,
    can only be within a word, so it is looked for in the words that have its first GRAM characters."""

    GRAM = 6

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.words: dict[str, list[int]] = {}
        self.grams: dict[str, list[str]] = {}
        self.known: dict[str, np.ndarray] = {}
        for i, t in enumerate(texts):
            for w in set(t.split()):
                if len(w) >= self.GRAM:
                    self.words.setdefault(w, []).append(i)
        for w in self.words:
            for g in {w[j : j + self.GRAM] for j in range(len(w) - self.GRAM + 1)}:
                self.grams.setdefault(g, []).append(w)

    def _find(self, x: str) -> np.ndarray:
        if len(x) < self.GRAM or x.split() != [x]:
            return np.array([i for i, t in enumerate(self.texts) if x in t], np.int64)
        return np.array(sorted({i for w in self.grams.get(x[: self.GRAM], ()) if x in w for i in self.words[w]}), np.int64)

    def parts(self, wanted: list[str]) -> np.ndarray:
        """Of each text the part of these strings that it contains."""
        hits = np.zeros(len(self.texts))
        for x in wanted:
            found = self.known.get(x)
            if found is None:
                found = self.known[x] = self._find(x)
            if len(found):
                hits[found] += 1
        return hits / len(wanted)


def phrase_bonus(text: Column, phrases: Column) -> Column:
    """Part of the phrases that the text contains."""
    return _part_matched(text, phrases)


def rare_bonus(text: Column, tokens: Column) -> Column:
    return _part_matched(text, tokens)


def metadata_signal(path: Column, facets: Column, query_facets: list[str] | tuple[str, ...] = ()) -> Column:
    """Struct of the bonuses for a primary source, an era and a category that the query asks for, and their total."""
    low = F.lower(path)
    primary = F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in PRIMARY_WORDS]), PRIMARY_BONUS).otherwise(0.0)

    def any_of(wanted: list[str], bonus: float) -> Column:
        if not wanted:
            return F.lit(0.0)
        return F.when(F.exists(facets, lambda v: reduce(Column.__or__, [matches_exactly(v, f) for f in wanted])), bonus).otherwise(0.0)

    era = any_of([f for f in query_facets if dimension_of(f) == 2], ERA_BONUS)
    category = any_of([f for f in query_facets if dimension_of(f) == 0], CATEGORY_BONUS)
    return F.struct(primary.alias("primary_source"), era.alias("era"), category.alias("category"), (primary + era + category).alias("total"))


def with_duplicate_penalty(df: DataFrame, penalty: float) -> DataFrame:
    """fused_score less the penalty for all but the first row, by score and line_id, of a query with the same non-zero line_hash."""
    w = Window.partitionBy("query_id", "line_hash").orderBy(F.desc("fused_score"), "line_id")
    again = (F.col("line_hash") != 0) & (F.row_number().over(w) > 1)
    return df.withColumn("_again", again).withColumn("fused_score", F.when(F.col("_again"), F.col("fused_score") - penalty).otherwise(F.col("fused_score"))).drop("_again")


def fuse(lexical: DataFrame, semantic: DataFrame, queries: DataFrame, profile: RankingProfile, mode: str = HYBRID, query_facets: tuple[str, ...] = ()) -> DataFrame:
    """The merged candidates of each query with fused_score. queries: query_id, alpha, quoted_phrases, rare_tokens.

    The lexical side's fields win; a line that only the semantic side has is without text until it is hydrated. RRF applies in
    hybrid mode only, ranks the lexical side by its list, leaves out semantic lines of score 0, and takes no bonus."""
    rrf = profile.rrf_k if mode == HYBRID else None
    texts, told = "text" in lexical.columns, "text_parts" in lexical.columns
    fields = [c for c in SIBLINGS if c != "text"]
    no = lambda t: F.lit(None).cast(t)
    parts = "array<struct<phrase:double,rare:double>>"
    lex = lexical.select("query_id", "line_id", F.lit(False).alias("_sem"), F.col("bm25_score").cast("double").alias("_score"), F.col("rank").alias("_rank"), *fields, (F.col("text") if texts else F.lit("")).alias("text"), F.col("bm25_score").alias("_bm25"), no("double").alias("_similarity"), no("double").alias("_bonus"), (F.col("text_parts") if told else no(parts)).alias("_parts"))
    bonus = metadata_signal(F.col("source_book_key"), F.col("facets"), query_facets)["total"] if profile.metadata_ranking_enabled and rrf is None else F.lit(0.0)
    sem = semantic.select("query_id", "line_id", F.lit(True).alias("_sem"), F.col("similarity").alias("_score"), F.col("rank").alias("_rank"), *[F.col("source_book_key" if c == "file_path" else c).alias(c) for c in fields], F.lit("").alias("text"), no(lexical.schema["bm25_score"].dataType).alias("_bm25"), F.col("similarity").alias("_similarity"), bonus.alias("_bonus"), no(parts).alias("_parts"))
    # both sides lie together by query, sorted once: the best row of a line on each side, and then the two sides of a line, are neighbours
    by_query = Window.partitionBy("query_id")
    by_line = by_query.orderBy("line_id", "_sem", F.desc("_score"), "_rank")
    again = F.coalesce((F.lag("line_id").over(by_line) == F.col("line_id")) & (F.lag("_sem").over(by_line) == F.col("_sem")), F.lit(False))
    rows = lex.unionByName(sem).withColumn("_again", again).where(~F.col("_again")).drop("_again")
    if rrf is not None:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("query_id", "_sem").orderBy("_rank")))
    else:
        rows = rows.withColumn("_place", F.lit(0))
    score = F.when(~F.col("_sem"), F.col("_score"))
    norm_l = normalize_bm25_adaptive(score, by_query) if profile.adaptive else normalize_bm25(score)
    norm_s = thresholded(normalize_semantic(F.col("_similarity")), profile.threshold)
    rows = rows.withColumns({"_l": F.when(~F.col("_sem"), norm_l), "_s": F.when(F.col("_sem"), norm_s)})
    if rrf is not None:
        rows = rows.where(~F.col("_sem") | (F.col("_s") > 0))
    by_line = by_query.orderBy("line_id", "_sem")
    paired = F.coalesce(F.lead("line_id").over(by_line) == F.col("line_id"), F.lit(False))
    second = F.coalesce(F.lag("line_id").over(by_line) == F.col("line_id"), F.lit(False))
    other = lambda c: F.when(F.col("_sem"), F.col(c)).when(F.col("_paired"), F.lead(c).over(by_line))
    rows = rows.withColumns({"_paired": paired, "_second": second})
    rows = rows.withColumns({"raw_semantic_score": other("_similarity"), "normalized_semantic": other("_s"), "s_rank": other("_place"), "metadata_bonus": other("_bonus")}).where(~F.col("_second"))
    has_lex, has_sem = ~F.col("_sem"), F.col("_sem") | F.col("_paired")
    rows = rows.withColumns({"normalized_bm25": F.col("_l"), "raw_bm25_score": F.col("_bm25"), "l_rank": F.when(has_lex, F.col("_place"))})
    both = rows.join(queries.select("query_id", "alpha", *(["nth"] if told else ["quoted_phrases", "rare_tokens"])), "query_id")
    if rrf is not None:
        fused = F.coalesce(1 / (F.col("l_rank") + rrf), F.lit(0.0)) + F.coalesce(1 / (F.col("s_rank") + rrf), F.lit(0.0))
    else:
        fused = F.coalesce(F.col("alpha") * F.col("normalized_bm25"), F.lit(0.0)) + F.coalesce((1 - F.col("alpha")) * F.col("normalized_semantic"), F.lit(0.0)) + F.coalesce("metadata_bonus", F.lit(0.0))
        if mode == HYBRID:
            fused = fused + F.when(has_lex & has_sem, max(0.0, profile.agreement_bonus)).otherwise(0.0)
    out = both.select(
        "query_id",
        "line_id",
        *SIBLINGS,
        (~has_lex if texts else F.lit(True)).alias("needs_hydration"),
        source_of(has_lex, has_sem).alias("source"),
        "raw_bm25_score",
        "normalized_bm25",
        "raw_semantic_score",
        "normalized_semantic",
        F.col("alpha").alias("lexical_weight"),
        (1 - F.col("alpha")).alias("semantic_weight"),
        fused.alias("fused_score"),
        (F.element_at("_parts", F.col("nth") + 1) if told else F.struct(phrase_bonus(F.col("text"), F.col("quoted_phrases")).alias("phrase"), rare_bonus(F.col("text"), F.col("rare_tokens")).alias("rare"))).alias("_parts"),
    )
    if rrf is None:
        extra = F.lit(0.0)
        if profile.phrase_match_bonus > 0:
            extra = extra + profile.phrase_match_bonus * F.coalesce("_parts.phrase", F.lit(0.0))
        if profile.rare_term_bonus > 0:
            extra = extra + profile.rare_term_bonus * F.coalesce("_parts.rare", F.lit(0.0))
        if profile.section_coverage_bonus > 0:
            n = F.count("*").over(Window.partitionBy("query_id", "file_path", "section_id"))
            extra = extra + F.when(n > 1, profile.section_coverage_bonus).otherwise(0.0)
        out = out.withColumn("fused_score", F.col("fused_score") + extra)
        if profile.duplicate_penalty > 0:
            out = with_duplicate_penalty(out, profile.duplicate_penalty)
    return out.drop("_parts")


def confidence(df: DataFrame, score: str = "fused_score") -> DataFrame:
    """query_id and confidence: the gap between the two best scores by the best; null with fewer than two rows or no positive one."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "line_id")
    top = df.select("query_id", "line_id", F.col(score).alias("top"), F.lead(score).over(w).alias("second"), F.row_number().over(w).alias("n")).where("n = 1")
    ok = F.col("second").isNotNull() & ~F.isnan("top") & ~F.isnan("second") & (F.col("top") > 0)
    return top.select("query_id", F.when(ok, clamp((F.col("top") - F.col("second")) / F.greatest(F.col("top"), F.lit(1e-6)))).alias("confidence"))


def hydrate(fused: DataFrame, lines: DataFrame) -> DataFrame:
    """fused with the text of lines (line_id, text) where it is wanting."""
    texts = lines.select("line_id", F.col("text").alias("_text"))
    return fused.join(texts, "line_id", "left").withColumn("text", F.when(F.col("needs_hydration"), F.coalesce("_text", F.col("text"))).otherwise(F.col("text"))).drop("_text")
