"""An extension: lines that arrive as a stream are indexed batch by batch. The engine it follows has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import SemanticIndex


def index_stream(lines: DataFrame, books: DataFrame, index: SemanticIndex, checkpoint: str) -> StreamingQuery:
    """Each micro-batch holds whole books, which replace what was indexed of them; a batch that is repeated after a failure finds its
    books current and changes nothing."""

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        touched = batch.select("source_book_key").distinct()
        index.index_books(books.join(touched, "source_book_key", "left_semi"), batch)
        batch.unpersist()

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
