"""The manifest: which books are indexed, and under which model, store and algorithms. A JSON document with a row for each book."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

FORMAT = 5
NAME = "manifest.json"
BOOK_SCHEMA = "source_book_key string, content_hash bigint, line_fingerprint bigint, chunk_count bigint, indexed_at bigint, chunking_identity bigint, normalization_version int"


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class ManifestConfig:
    embedding_model_id: str
    embedding_dim: int
    chunking_identity: int
    normalization_version: int = 1
    model_checksum: str | None = None
    embedding_backend: str | None = None
    pooling: str = "last"
    embedding_max_tokens: int = 512
    model_quantization: str = ""
    vector_precision: str = "f32"
    vector_backend: str = "parquet"


#: Compared only if both sides know it.
IF_KNOWN = "model_checksum", "embedding_backend"
#: A difference in these doesn't make stored vectors those of another model.
NOT_OF_MODEL = "chunking_identity", "normalization_version"


@dataclass(frozen=True)
class Manifest:
    config: ManifestConfig
    books: dict[str, dict] = field(default_factory=dict)
    created_at: int = 0
    updated_at: int = 0

    def mismatches(self, config: ManifestConfig) -> list[tuple[str, object, object]]:
        """(field, here, there) of every disagreement, in order of the fields."""
        out = []
        for f in ("embedding_model_id", *IF_KNOWN, "embedding_dim", "pooling", "embedding_max_tokens", "model_quantization", "vector_precision", "vector_backend", *NOT_OF_MODEL):
            a, b = getattr(self.config, f), getattr(config, f)
            if a != b and not (f in IF_KNOWN and (a is None or b is None)):
                out.append((f, a, b))
        return out

    def invalidates_vectors(self, config: ManifestConfig) -> bool:
        return any(f not in NOT_OF_MODEL for f, *_ in self.mismatches(config))

    def with_books(self, rows: list[dict]) -> Manifest:
        now = int(time.time())
        return replace(self, books=self.books | {r["source_book_key"]: {"indexed_at": now} | r for r in rows}, updated_at=now)

    def without(self, keys) -> Manifest:
        gone = set(keys)
        return replace(self, books={k: v for k, v in self.books.items() if k not in gone}, updated_at=int(time.time()))

    def to_df(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in BOOK_SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(b.get(n) for n in names) for _, b in sorted(self.books.items())], BOOK_SCHEMA)


def load(folder: str) -> Manifest | None:
    """The manifest, or the parked or the unfinished copy that a lost writer left; None if there is none."""
    for name in (NAME, f"{NAME}.previous", f"{NAME}.tmp"):
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            continue
        try:
            with open(path, encoding="utf-8") as f:
                d = json.load(f)
        except ValueError:
            if name == NAME:
                raise ManifestError(f"{path} can't be read") from None
            continue
        if d.get("format") != FORMAT:
            raise ManifestError(f"{path} is of format {d.get('format')}, not {FORMAT}")
        return Manifest(ManifestConfig(**d["config"]), d["books"], d["created_at"], d["updated_at"])
    return None


def save(manifest: Manifest, folder: str) -> None:
    """Written beside the old one, then renamed over it."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, NAME)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({"format": FORMAT, "config": asdict(manifest.config), "books": manifest.books, "created_at": manifest.created_at or int(time.time()), "updated_at": manifest.updated_at}, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
    fd = os.open(folder, os.O_RDONLY)
    os.fsync(fd)
    os.close(fd)


def quarantine(folder: str, tag: str) -> str | None:
    """Renames a manifest that can't be used, with a tag and the time; its new name."""
    path = os.path.join(folder, NAME)
    if not os.path.exists(path):
        return None
    new = f"{path}.{tag}.{int(time.time())}"
    os.rename(path, new)
    return new
