"""Artifacts: an identity, payload files and their digests, checked before they are installed or opened."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import time
from dataclasses import asdict, dataclass, fields

METADATA_VERSION = 2
MANIFEST, PAYLOADS = "manifest.json", "payloads.json"
DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{a}{n}" for a in ("COM", "LPT") for n in range(1, 10))}


class ArtifactError(ValueError):
    """The base of all refusals."""


class WrongArtifact(ArtifactError):
    """A sound artifact, but of another identity."""


class DamagedArtifact(ArtifactError):
    """Files are missing, or aren't what the metadata says."""


class UnpublishedArtifact(ArtifactError):
    """Not the artifact whose digest was published."""


class IncompleteIdentity(ArtifactError):
    pass


class UnsafePayloadName(ArtifactError):
    pass


@dataclass(frozen=True)
class IndexVersion:
    """The identity of an index: of its corpus, of the model, and of the store."""

    corpus_id: str
    library_version: str
    lexical_schema_version: int
    document_id_scheme_version: int
    model_id: str
    model_checksum: str
    model_quantization: str
    embedding_backend: str
    embedding_dim: int
    pooling: str
    max_tokens: int
    embedding_text_version: int
    normalization_version: int
    chunking_identity: int
    store_backend_id: str
    store_format_version: int
    vector_precision: str

    def mismatches(self, other: IndexVersion) -> list[tuple[str, object, object]]:
        """(field, here, there) of all that differ, in order."""
        return [(f.name, getattr(self, f.name), getattr(other, f.name)) for f in fields(self) if getattr(self, f.name) != getattr(other, f.name)]

    def require_match(self, other: IndexVersion) -> None:
        if bad := self.mismatches(other):
            raise WrongArtifact("; ".join(f"{f}: {a!r}, not {b!r}" for f, a, b in bad))

    def require_complete(self) -> None:
        """Blank texts, zeros, control characters and checksums that are none are refused: two unfilled identities would agree."""
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, int):
                if v <= 0:
                    raise IncompleteIdentity(f"{f.name} is zero")
            elif f.name == "model_checksum":
                if not re.fullmatch("[0-9a-f]{64}", v):
                    raise IncompleteIdentity(f"{f.name} is no SHA-256 in lower case")
            elif not v.strip():
                raise IncompleteIdentity(f"{f.name} is blank")
            elif any(ord(c) < 32 or 127 <= ord(c) < 160 for c in v):
                raise IncompleteIdentity(f"{f.name} has a control character")


def check_payload_name(name: str) -> None:
    """A plain file name that means the same on every system."""
    why = None
    if not name:
        why = "is empty"
    elif len(name.encode()) > 255:
        why = "is longer than 255 bytes"
    elif not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        why = "has a character other than letters, digits, dot, underscore and hyphen"
    elif name[0] == "." or name[-1] == ".":
        why = "begins or ends with a dot"
    elif name.lower() in (MANIFEST, PAYLOADS):
        why = "would replace the metadata"
    elif name.split(".")[0].upper() in DEVICES:
        why = "is the name of a device"
    if why:
        raise UnsafePayloadName(f"{name!r} {why}")


def utc_now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


@dataclass(frozen=True)
class Package:
    identity: IndexVersion
    book_count: int
    vector_count: int
    total_size_bytes: int
    payloads: dict[str, dict]
    created_at: str = ""
    metadata_version: int = METADATA_VERSION

    @classmethod
    def describe(cls, root: str, identity: IndexVersion, book_count: int, vector_count: int, created_at: str = "") -> Package:
        """Of the files of a folder."""
        identity.require_complete()
        payloads = {}
        for name in sorted(os.listdir(root)):
            if name in (MANIFEST, PAYLOADS):
                continue
            check_payload_name(name)
            path = os.path.join(root, name)
            payloads[name] = {"sha256": sha256_file(path), "size_bytes": os.path.getsize(path)}
        return cls(identity, book_count, vector_count, sum(p["size_bytes"] for p in payloads.values()), payloads, created_at or utc_now())

    def write(self, root: str) -> None:
        body = {"metadata_version": self.metadata_version, "identity": asdict(self.identity), "book_count": self.book_count, "vector_count": self.vector_count, "total_size_bytes": self.total_size_bytes, "created_at": self.created_at}
        for name, data in ((PAYLOADS, self.payloads), (MANIFEST, body)):
            with open(os.path.join(root, name), "w", encoding="utf-8") as f:
                json.dump(data, f, sort_keys=True, indent=1)

    @classmethod
    def read(cls, root: str) -> Package:
        try:
            with open(os.path.join(root, MANIFEST), encoding="utf-8") as f:
                body = json.load(f)
            with open(os.path.join(root, PAYLOADS), encoding="utf-8") as f:
                payloads = json.load(f)
            if body["metadata_version"] != METADATA_VERSION:
                raise ArtifactError(f"metadata of version {body['metadata_version']}")
            return cls(IndexVersion(**body.pop("identity")), payloads=payloads, **body)
        except (OSError, KeyError, TypeError, json.JSONDecodeError) as e:
            raise DamagedArtifact(f"the metadata can't be read: {e}") from None

    def digest(self) -> str:
        """Of all but created_at, so that a build repeated has the digest again."""
        rows = ["fathom-artifact-1", f"metadata_version={self.metadata_version}", *(f"{k}={v}" for k, v in asdict(self.identity).items())]
        rows += [f"{k}={getattr(self, k)}" for k in ("book_count", "vector_count", "total_size_bytes")]
        rows += [f"payload {k}={v['sha256']} {v['size_bytes']}" for k, v in sorted(self.payloads.items())]
        return hashlib.sha256("".join(r + "\n" for r in rows).encode()).hexdigest()

    def check_files(self, root: str, full: bool) -> None:
        """Names, presence, kind and size of every payload; full: its digest too."""
        if not self.payloads:
            raise DamagedArtifact("no payload")
        lower: dict[str, str] = {}
        for name, p in self.payloads.items():
            check_payload_name(name)
            if (other := lower.setdefault(name.lower(), name)) != name:
                raise UnsafePayloadName(f"{name!r} and {other!r} differ in case only")
            if not re.fullmatch("[0-9a-fA-F]{64}", p["sha256"]):
                raise DamagedArtifact(f"{name}: no SHA-256")
        if self.vector_count <= 0 or self.book_count <= 0:
            raise DamagedArtifact("it counts no vector or no book")
        total = 0
        for name, p in sorted(self.payloads.items()):
            path = os.path.join(root, name)
            if not os.path.lexists(path):
                raise DamagedArtifact(f"{name} is missing")
            if os.path.islink(path) or not os.path.isfile(path):
                raise DamagedArtifact(f"{name} is no regular file")
            if (size := os.path.getsize(path)) != p["size_bytes"]:
                raise DamagedArtifact(f"{name} has {size} bytes, not {p['size_bytes']}")
            if full and sha256_file(path) != p["sha256"]:
                raise DamagedArtifact(f"{name} has another digest")
            total += size
        if total != self.total_size_bytes:
            raise DamagedArtifact(f"{total} bytes, not {self.total_size_bytes}")


_TOKEN = object()


@dataclass(frozen=True)
class VerifiedPackage:
    """Proof that a package was verified: only verify_for_install and verify_for_open make it."""

    root: str
    package: Package
    full: bool
    token: object

    def __post_init__(self):
        if self.token is not _TOKEN:
            raise ArtifactError("a package is verified by verify_for_install or verify_for_open")


def _verify(root: str, expected: IndexVersion, published: str | None, full: bool) -> VerifiedPackage:
    p = Package.read(root)
    p.identity.require_complete()
    p.identity.require_match(expected)
    if published is not None and p.digest() != published:
        raise UnpublishedArtifact(p.digest())
    p.check_files(root, full)
    return VerifiedPackage(root, p, full, _TOKEN)


def verify_for_install(root: str, expected: IndexVersion, published: str | None = None) -> VerifiedPackage:
    """Reads every byte."""
    return _verify(root, expected, published, True)


def verify_for_open(root: str, expected: IndexVersion, published: str | None = None) -> VerifiedPackage:
    """Reads no payload: what an installed artifact gets at every start."""
    return _verify(root, expected, published, False)


def recover_interrupted_install(target: str) -> str:
    """Puts back what an install that was cut off had parked, and removes what it had staged: nothing, restored or cleaned."""
    staged, parked = f"{target}.staged", f"{target}.previous"
    if not os.path.exists(target) and os.path.exists(parked):
        os.rename(parked, target)
        shutil.rmtree(staged, ignore_errors=True)
        return "restored"
    found = os.path.exists(staged) or os.path.exists(parked)
    shutil.rmtree(staged, ignore_errors=True)
    shutil.rmtree(parked, ignore_errors=True)
    return "cleaned" if found else "nothing"


def install(source: str, target: str, expected: IndexVersion, published: str | None = None) -> VerifiedPackage:
    """Verifies, copies beside the target, verifies the copy, and swaps it in; the old one comes back if that fails."""
    verify_for_install(source, expected, published)
    recover_interrupted_install(target)
    staged, parked = f"{target}.staged", f"{target}.previous"
    shutil.copytree(source, staged)
    try:
        verify_for_install(staged, expected, published)
        if os.path.exists(target):
            os.rename(target, parked)
        os.rename(staged, target)
    except Exception:
        recover_interrupted_install(target)
        raise
    shutil.rmtree(parked, ignore_errors=True)
    return verify_for_open(target, expected, published)
