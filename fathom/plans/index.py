"""The life of an index: books become chunks and vectors, unchanged ones are skipped, and the manifest keeps account."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import lifecycle
from ..operators.chunking import chunk_lines, vector_metadata
from ..sources import manifest_store
from ..sources.vector_store import ReadOnlyError, VectorStore
from .embedding import Embedder, embed_column

RECORD = "semantic_id string, source_book_key string, source_doc_key string, line_id bigint, section_id bigint, line_hash bigint, chunk_hash string, content_hash bigint, reference string, segment bigint, is_pdf boolean, title string, facets array<string>, vector array<float>"


class IncompatibleIndexError(ValueError):
    pass


@dataclass(frozen=True)
class Summary:
    indexed_books: int = 0
    skipped_books: int = 0
    empty_books: int = 0
    indexed_chunks: int = 0


@dataclass(frozen=True)
class IndexDiff:
    new_books: list[str]
    changed_books: list[str]
    unverifiable_books: list[str]
    removed_books: list[str]
    model_mismatch: bool = False
    chunking_mismatch: bool = False
    normalization_mismatch: bool = False

    @property
    def needs_work(self) -> bool:
        return bool(self.new_books or self.changed_books or self.unverifiable_books or self.removed_books)


@dataclass(frozen=True)
class Status:
    available: bool
    vectors: int = 0
    books: int = 0
    empty_books: int = 0
    model_id: str = ""
    embedding_backend: str = ""
    dim: int = 0
    read_only: bool = False
    mismatches: tuple = field(default_factory=tuple)


class SemanticIndex:
    """A vector store and its manifest in one folder. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, config: manifest_store.ManifestConfig, embedder: Embedder | None = None, chunker: hashing.ChunkerConfig = hashing.ChunkerConfig(), read_only: bool = False):
        self.spark, self.folder, self.config, self.embedder, self.chunker, self.read_only = spark, folder, config, embedder, chunker, read_only
        self.store = VectorStore(spark, f"{folder}/vectors", config.embedding_dim, RECORD)
        self.manifest = manifest_store.load(folder) or manifest_store.Manifest(config)
        self.mismatches = self.manifest.mismatches(config)

    def _writable(self, name: str, compatible: bool = True) -> None:
        if self.read_only:
            raise ReadOnlyError(name)
        if compatible and self.mismatches:
            raise IncompatibleIndexError(f"{name}: {self.mismatches}; reset the index first")

    def index_books(self, books: DataFrame, lines: DataFrame) -> Summary:
        """Chunks, embeds and stores the books that aren't current, in one write; vectors of a book are replaced, an empty book leaves a
        mark in the manifest. Everything is embedded before anything is stored."""
        self._writable("index_books")
        if self.embedder is None:
            raise IncompatibleIndexError("no embedding backend is configured")
        chunks = chunk_lines(books, lines, self.chunker)
        counts = chunks.groupBy("source_book_key").agg(F.count("*").alias("n"))
        computed = hashing.line_fingerprints(books, lines).join(counts, "source_book_key", "left").join(books.select("source_book_key", F.col("content_fingerprint").alias("content_hash")), "source_book_key")
        computed = computed.select("source_book_key", "content_hash", "line_fingerprint", F.coalesce("n", F.lit(0)).cast("bigint").alias("chunk_count"), F.lit(hashing.signed(self.chunker.identity)).alias("chunking_identity"), F.lit(self.config.normalization_version).alias("normalization_version"))
        state = lifecycle.is_current(computed, self.manifest.to_df(self.spark), lifecycle.book_counts(self.store.read())).join(computed, "source_book_key").collect()
        stale = [r for r in state if not r.current]
        if stale:
            keys = self.spark.createDataFrame([(r.source_book_key,) for r in stale], "source_book_key string")
            fresh = chunks.join(keys, "source_book_key", "left_semi")
            records = embed_column(fresh, "embedding_text", self.embedder)
            records = vector_metadata(records).select(*[c.split()[0] for c in RECORD.split(", ")])
            old = self.store.read().join(keys, "source_book_key", "left_anti")
            self.store._write(old.unionByName(records))
            fields = "source_book_key", "content_hash", "line_fingerprint", "chunk_count", "chunking_identity", "normalization_version"
            self.manifest = self.manifest.with_books([{f: r[f] for f in fields} for r in stale])
            manifest_store.save(self.manifest, self.folder)
        full = [r for r in stale if r.chunk_count]
        return Summary(len(full), len(state) - len(stale), len(stale) - len(full), sum(r.chunk_count for r in full))

    def remove_books(self, keys: list[str]) -> int:
        self._writable("remove_books")
        n = self.store.remove_books(keys)
        self.manifest = self.manifest.without(keys)
        manifest_store.save(self.manifest, self.folder)
        return n

    def reset(self) -> int:
        """Drops all vectors and entries and takes the present configuration."""
        self._writable("reset", compatible=False)
        n = self.store.clear()
        self.manifest, self.mismatches = manifest_store.Manifest(self.config), []
        manifest_store.save(self.manifest, self.folder)
        return n

    def diff(self, library: DataFrame) -> IndexDiff:
        """library: source_book_key, kind and hash of every book."""
        names = {f for f, *_ in self.mismatches}
        flags = bool(names - set(manifest_store.NOT_OF_MODEL)), "chunking_identity" in names, "normalization_version" in names
        rows = lifecycle.index_diff(library, self.manifest.to_df(self.spark), hashing.signed(self.chunker.identity), self.config.normalization_version, any(flags)).where(F.col("need") != lifecycle.UP_TO_DATE).orderBy("source_book_key").collect()
        by = lambda need: [r.source_book_key for r in rows if r.need == need]
        return IndexDiff(by(lifecycle.NEW), by(lifecycle.CHANGED), by(lifecycle.UNVERIFIABLE), by(lifecycle.REMOVED), *flags)

    def diff_from_hashes(self, hashes: DataFrame) -> IndexDiff:
        """hashes: source_book_key and hash, 0 for none."""
        return self.diff(hashes.withColumn("kind", lifecycle.fingerprint_kind(F.col("hash"))))

    def status(self) -> Status:
        t = lifecycle.manifest_totals(self.manifest.to_df(self.spark)).first()
        c = self.manifest.config
        return Status(True, self.store.count(), t.book_count, t.empty_book_count, c.embedding_model_id, c.embedding_backend or "", c.embedding_dim, self.read_only, tuple(self.mismatches))
