"""Groups behind a representative, and pages of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAME_SECTION, IDENTICAL_TEXT = "SameSection", "IdenticalText"
MAX_SIBLINGS = 10
MAX_WINDOW = 10_000
SIBLING = "title", "reference", "line_id", "segment", "is_pdf", "file_path"


def group_key(mode: str) -> Column:
    """Lines of one section of a file, or lines with the same signature; a line_hash of 0 is like no other."""
    if mode == SAME_SECTION:
        return F.concat_ws("\x1f", F.col("section_id").cast("string"), "file_path")
    if mode == IDENTICAL_TEXT:
        return F.when(F.col("line_hash") == 0, F.concat(F.lit("u"), F.col("line_id").cast("string"))).otherwise(F.concat(F.lit("h"), F.col("line_hash").cast("string")))
    raise ValueError(mode)


def group(fused: DataFrame, mode: str = SAME_SECTION, most: int = MAX_SIBLINGS) -> DataFrame:
    """The best row of each group, by score and then by line_id, with siblings (the next `most`) and group_count (all of them)."""
    w = Window.partitionBy("query_id", "_key").orderBy(F.desc("fused_score"), "line_id")
    rows = fused.withColumn("_key", group_key(mode)).withColumn("_n", F.row_number().over(w))
    whole = Window.partitionBy("query_id", "_key")
    sibling = F.when(F.col("_n").between(2, most + 1), F.struct("_n", *SIBLING))
    rows = rows.withColumn("group_count", F.count("*").over(whole)).withColumn("siblings", F.array_sort(F.collect_list(sibling).over(whole)))
    strip = F.transform("siblings", lambda s: F.struct(*[s[c].alias(c) for c in SIBLING]))
    return rows.where("_n = 1").withColumn("siblings", strip).drop("_n", "_key")


def page(df: DataFrame, offset: int, limit: int, score: str = "fused_score") -> DataFrame:
    """Rows offset to offset + limit of each query, with position from 0."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "line_id")
    return df.withColumn("position", F.row_number().over(w) - 1).where((F.col("position") >= offset) & (F.col("position") < offset + limit))


def result_items(groups: DataFrame) -> DataFrame:
    """Representatives as result rows: merged (the siblings), merged_count and provenance (the scores)."""
    scores = "source", "raw_bm25_score", "normalized_bm25", "raw_semantic_score", "normalized_semantic", "fused_score", "lexical_weight", "semantic_weight"
    return groups.withColumn("provenance", F.struct(*scores)).withColumnsRenamed({"siblings": "merged", "group_count": "merged_count"})


def candidate_window(limit: int, offset: int, multiplier: float) -> int:
    """How many candidates to fetch for a page."""
    m = min(10.0, max(1.0, multiplier)) if math.isfinite(multiplier) else 2.0
    return min(MAX_WINDOW, max(1, offset + math.ceil(limit * m)))
