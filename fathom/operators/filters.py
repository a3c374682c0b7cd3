"""Search filters as one predicate column, built once for a scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facets import clean, dimension_of, matches


@dataclass(frozen=True)
class SearchFilters:
    """Facets of one dimension are alternatives, dimensions must all agree. None and no value both mean no filter; include_pdf
    filters only if it is False."""

    book_paths: tuple[str, ...] | None = None
    facets: tuple[str, ...] | None = None
    include_pdf: bool | None = None

    @property
    def is_empty(self) -> bool:
        return not self.book_paths and not self.facets and self.include_pdf is not False

    def predicate(self) -> Column | None:
        """Over source_book_key, facets and is_pdf; None if nothing is filtered."""
        parts: list[Column] = []
        if self.book_paths:
            parts.append(F.col("source_book_key").isin(list(self.book_paths)))
        if self.include_pdf is False:
            parts.append(~F.col("is_pdf"))
        groups: dict[int, list[str]] = {}
        for f in self.facets or ():
            groups.setdefault(dimension_of(clean(f)), []).append(f)
        any_of = lambda wanted: F.exists("facets", lambda v: reduce(Column.__or__, [matches(v, f) for f in wanted]))
        parts += [any_of(wanted) for wanted in groups.values()]
        return reduce(Column.__and__, parts) if parts else None

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        return df if p is None else df.where(p)
