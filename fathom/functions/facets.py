"""Facet paths: their dimension, hierarchical matching and canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import unicode_trim

DIMENSIONS = ("author", "era", "base")


def clean(path: str) -> str:
    return path.strip().rstrip("/")


def dimension_of(path: str) -> int:
    """1, 2 or 3 for author, era and base; 0 for the category tree."""
    first = path.lstrip("/").split("/")[0]
    return DIMENSIONS.index(first) + 1 if first in DIMENSIONS else 0


def dimension(path: Column) -> Column:
    first = F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1))
    return F.coalesce(F.array_position(F.array(*map(F.lit, DIMENSIONS)), first), F.lit(0)).cast("int")


def matches(value: Column, wanted: str | Column) -> Column:
    """Whether value is the wanted path or below it; blanks around and slashes after either don't count."""
    strip = lambda c: F.regexp_replace(unicode_trim(c), "/+$", "")
    v = strip(value)
    w = F.lit(clean(wanted)) if isinstance(wanted, str) else strip(wanted)
    return (v == w) | F.startswith(v, F.concat(w, F.lit("/")))


def matches_exactly(value: Column, wanted: str | Column) -> Column:
    """As the ranker matches: nothing is cleaned."""
    w = F.lit(wanted) if isinstance(wanted, str) else wanted
    return (value == w) | F.startswith(value, F.concat(w, F.lit("/")))


def canonical(facets: Column) -> Column:
    """Sorted, without blanks and repeats."""
    return F.array_sort(F.array_distinct(F.filter(facets, lambda f: unicode_trim(f) != "")))


def all_facets(topics: Column, extra: Column) -> Column:
    """The category path and the further facets, canonical."""
    return canonical(F.concat(F.array(topics), extra))
