"""Checks a GGUF model file's container and hashes it in one pass."""

from __future__ import annotations

import hashlib
import struct

MAGIC = b"GGUF"
MOST_ENTRIES = 1 << 24
MOST_DESCRIPTOR_BYTES = 64 << 20
WIDTH = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
STRING, ARRAY = 8, 9


class GgufError(ValueError):
    pass


class _Reader:
    def __init__(self, f):
        self.f, self.hash, self.at = f, hashlib.sha256(), 0

    def take(self, n: int, what: str) -> bytes:
        if self.at + n > MOST_DESCRIPTOR_BYTES:
            raise GgufError(f"the descriptors exceed {MOST_DESCRIPTOR_BYTES} bytes at {what}")
        data = self.f.read(n)
        if len(data) < n:
            raise GgufError(f"the file ends within {what}")
        self.hash.update(data)
        self.at += n
        return data

    def u32(self, what: str) -> int:
        return struct.unpack("<I", self.take(4, what))[0]

    def u64(self, what: str) -> int:
        return struct.unpack("<Q", self.take(8, what))[0]

    def skip_value(self, kind: int, depth: int = 0) -> None:
        if kind in WIDTH:
            self.take(WIDTH[kind], "a value")
        elif kind == STRING:
            self.take(self.u64("a length"), "a string")
        elif kind == ARRAY and depth < 4:
            inner, n = self.u32("a kind"), self.u64("a length")
            if inner in WIDTH:
                self.take(WIDTH[inner] * n, "an array")
            else:
                if n > MOST_ENTRIES:
                    raise GgufError(f"an array of {n} values")
                for _ in range(n):
                    self.skip_value(inner, depth + 1)
        else:
            raise GgufError(f"a value of unknown kind {kind}")


def validate(path: str) -> str:
    """The file's SHA-256. An error if it isn't a GGUF file of version 2 or 3, or is shorter than its tensors need at one bit each."""
    with open(path, "rb") as f:
        r = _Reader(f)
        if r.take(4, "the magic number") != MAGIC:
            raise GgufError("not a GGUF file")
        if (version := r.u32("the version")) not in (2, 3):
            raise GgufError(f"version {version}")
        tensors, entries = r.u64("the number of tensors"), r.u64("the number of entries")
        if not 0 < tensors <= MOST_ENTRIES or entries > MOST_ENTRIES:
            raise GgufError(f"{tensors} tensors, {entries} entries")
        align = 32
        for _ in range(entries):
            n = r.u64("a key's length")
            if n > 0xFFFF:
                raise GgufError(f"a key of {n} bytes")
            key, kind = r.take(n, "a key"), r.u32("a kind")
            if key == b"general.alignment":
                if kind != 4:
                    raise GgufError("the alignment isn't a uint32")
                align = r.u32("the alignment")
                if align < 8 or align % 8:
                    raise GgufError(f"an alignment of {align}")
            else:
                r.skip_value(kind)
        need = 0
        for _ in range(tensors):
            n = r.u64("a name's length")
            if n > 64:
                raise GgufError(f"a tensor name of {n} bytes")
            r.take(n, "a name")
            dims = r.u32("a number of dimensions")
            if not 1 <= dims <= 4:
                raise GgufError(f"{dims} dimensions")
            elements = 1
            for _ in range(dims):
                elements *= max(1, r.u64("a dimension"))
            r.u32("a type")
            offset = r.u64("an offset")
            if offset % align:
                raise GgufError(f"an offset of {offset}")
            need = max(need, offset + max(1, -(-elements // 8)))
        start = -(-r.at // align) * align
        size = r.at
        while data := f.read(1 << 20):
            r.hash.update(data)
            size += len(data)
        if size < start + need:
            raise GgufError(f"{size} bytes, but the tensors reach to {start + need}")
        return r.hash.hexdigest()
