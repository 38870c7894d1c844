"""Manifests as JSON and as compact bytes, and where they are kept."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import sys
import tempfile
from dataclasses import dataclass
from datetime import UTC, datetime
from enum import Enum

from treeloom.functions.hashing import blake3
from treeloom.schemas import CHUNKER_NAME, FORMAT, HASH, MAGIC, MANIFEST_NAME, STATE_DIR, VERSION

#: Limits of a decoder: bytes of a string, counts of shards, parts, files, chunks, and chunks in all.
MOST_STRING, MOST_SHARDS, MOST_PARTS, MOST_FILES, MOST_CHUNKS, TRAILER = 1 << 20, 1 << 20, 1 << 20, 1 << 24, 1 << 28, 32


@dataclass(frozen=True)
class Dialect:
    """Names by which manifests are told apart. Others' manifests are read with theirs."""

    format: str = FORMAT
    magic: bytes = MAGIC
    chunker: str = CHUNKER_NAME
    hash: str = HASH


class Encoding(Enum):
    AUTO = "auto"
    JSON = "json"
    BINARY = "binary"


def parse_encoding(name: str) -> Encoding:
    try:
        return {"": Encoding.AUTO, "auto": Encoding.AUTO, "json": Encoding.JSON, "binary": Encoding.BINARY, "bin": Encoding.BINARY}[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown encoding {name!r}") from None


def encoding_for_path(path: str) -> Encoding:
    return Encoding.BINARY if os.path.splitext(path.lower())[1] in (".mmm", ".bin", ".manifest") else Encoding.JSON


class _Writer:
    def __init__(self):
        self.parts: list[bytes] = []

    def raw(self, b: bytes) -> None:
        self.parts.append(b)

    def u32(self, v: int) -> None:
        self.raw(struct.pack(">I", v))

    def uvarint(self, v: int) -> None:
        out = bytearray()
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
        self.raw(bytes(out))

    def varint(self, v: int) -> None:
        self.uvarint(v << 1 if v >= 0 else (-v << 1) - 1)

    def text(self, s: str) -> None:
        b = s.encode()
        self.uvarint(len(b))
        self.raw(b)

    def digest(self, hexed: str | None) -> None:
        self.raw(bytes.fromhex(hexed) if hexed else bytes(32))

    def sizes(self, c: dict) -> None:
        for k in ("avg_size", "min_size", "max_size"):
            self.u32(c.get(k) or 0)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("manifest is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack(">I", self.raw(4))[0]

    def uvarint(self) -> int:
        v = shift = 0
        while True:
            b = self.raw(1)[0]
            v |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
            if shift > 63:
                raise ValueError("number too large")
        if v >= 1 << 64:
            raise ValueError("number too large")
        return v

    def varint(self) -> int:
        v = self.uvarint()
        return v >> 1 if not v & 1 else -((v + 1) >> 1)

    def count(self, most: int) -> int:
        n = self.uvarint()
        if n > most:
            raise ValueError(f"count {n} is over the limit {most}")
        return n

    def size(self) -> int:
        n = self.uvarint()
        if n >= 1 << 63:
            raise ValueError("size too large")
        return n

    def text(self) -> str:
        return self.raw(self.count(MOST_STRING)).decode("utf-8", "surrogateescape")

    def digest(self) -> str | None:
        d = self.raw(32)
        return d.hex() if any(d) else None

    def sizes(self) -> dict:
        return {k: self.u32() for k in ("avg_size", "min_size", "max_size")}


def _rfc3339(ns: int) -> str:
    whole, part = divmod(ns, 10**9)
    said = datetime.fromtimestamp(whole, UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return said + (f".{part:09d}".rstrip("0") if part else "") + "Z"


def _ns(said: str) -> int:
    m = re.fullmatch(r"(.*?)(?:\.(\d{1,9})\d*)?(Z|[+-]\d\d:\d\d)", said)
    if not m:
        raise ValueError(f"not a time: {said!r}")
    whole = datetime.fromisoformat(m[1] + ("+00:00" if m[3] == "Z" else m[3]))
    return int(whole.timestamp()) * 10**9 + int((m[2] or "0").ljust(9, "0"))


def encode_binary(m: dict, dialect: Dialect = Dialect()) -> bytes:
    """Offsets, totals and extra are not stored; a BLAKE3 of all before it ends the bytes."""
    if m.get("hash") != dialect.hash:
        raise ValueError(f"the binary form holds {dialect.hash} digests alone, not {m.get('hash')!r}")
    w = _Writer()
    w.raw(dialect.magic + bytes([VERSION, 1, 1, 0]))
    w.varint(m["created_ns"] // 10**9)
    w.text(m.get("tool") or "")
    w.sizes(m["chunker"])
    model = m["model"]
    for k in ("name", "kind", "root"):
        w.text(model.get(k) or "")
    w.digest(model.get("digest"))
    w.uvarint(len(model.get("shards") or []))
    for s in model.get("shards") or []:
        w.text(s["name"])
        w.uvarint(s["total"])
        w.uvarint(s["size"])
        w.uvarint(len(s["parts"]))
        for p in s["parts"]:
            w.text(p)
    w.uvarint(len(m["files"]))
    for f in m["files"]:
        w.text(f["path"])
        w.uvarint(f["size"])
        w.uvarint(f["mode"])
        w.varint(f["mtime_ns"])
        w.text(f["role"])
        w.digest(f["digest"])
        w.sizes(f["chunker"])
        w.uvarint(len(f["chunks"]))
        for c in f["chunks"]:
            w.uvarint(c["length"])
            w.digest(c["digest"])
    body = b"".join(w.parts)
    return body + blake3(body)


def decode_binary(data: bytes, dialect: Dialect = Dialect()) -> dict:
    r = _Reader(data)
    if r.raw(4) != dialect.magic:
        raise ValueError("not a manifest")
    version, hashed, chunked, _ = r.raw(4)
    if (version, hashed, chunked) != (VERSION, 1, 1):
        raise ValueError(f"unsupported version, hash or chunker: {version}, {hashed}, {chunked}")
    created, tool, sizes = r.varint(), r.text(), r.sizes()
    model = {"name": r.text(), "kind": r.text(), "root": r.text(), "digest": r.digest()}
    model["shards"] = [{"name": r.text(), "total": r.size(), "size": r.size(), "parts": [r.text() for _ in range(r.count(MOST_PARTS))]} for _ in range(r.count(MOST_SHARDS))]
    files, total = [], 0
    for _ in range(r.count(MOST_FILES)):
        f = {"path": r.text(), "size": r.size(), "mode": r.count((1 << 32) - 1), "mtime_ns": r.varint(), "role": r.text(), "digest": r.digest()}
        f["chunker"] = {"algorithm": dialect.chunker, **r.sizes()}
        n = r.count(MOST_CHUNKS - total)
        total, offset, f["chunks"] = total + n, 0, []
        for _ in range(n):
            length = r.count((1 << 32) - 1)
            f["chunks"].append({"offset": offset, "length": length, "digest": r.digest()})
            offset += length
        files.append(f)
    if r.raw(TRAILER) != blake3(data[: r.at - TRAILER]):
        raise ValueError("the manifest's digest does not match")
    m = {"format": dialect.format, "version": VERSION, "tool": tool, "created_ns": created * 10**9, "hash": dialect.hash, "chunker": {"algorithm": dialect.chunker, **sizes}, "model": model, "files": files}
    weights = [f for f in files if f["role"] == "weight"]
    model |= {"files": len(files), "size": sum(f["size"] for f in files), "weight_files": len(weights), "weight_bytes": sum(f["size"] for f in weights)}
    return m


def encode_json(m: dict) -> str:
    out = {k: m[k] for k in ("format", "version")}
    if m.get("tool"):
        out["tool"] = m["tool"]
    out |= {"created_at": _rfc3339(m["created_ns"]), "hash": m["hash"], "chunker": m["chunker"]}
    model = m["model"]
    out["model"] = {k: v for k in ("name", "kind", "root", "files", "size", "weight_files", "weight_bytes", "shards", "digest", "extra") if (v := model.get(k)) or k in ("kind", "files", "size", "weight_files", "weight_bytes", "digest")}
    out["model"]["digest"] = model.get("digest") or "0" * 64
    out["files"] = [{"path": f["path"], "size": f["size"], "mode": f["mode"], "mod_time": _rfc3339(f["mtime_ns"]), "role": f["role"], "digest": f["digest"] or "0" * 64, "chunker": f["chunker"], "chunks": f["chunks"]} for f in m["files"]]
    return json.dumps(out, indent=2, ensure_ascii=False) + "\n"


def decode_json(text: str) -> dict:
    m = json.loads(text)
    if not isinstance(m, dict):
        raise ValueError("not a manifest")
    clean = lambda d: None if not d or not d.strip("0") else bytes.fromhex(d).hex() if len(d) == 64 else _bad(d)
    out = {"format": m.get("format"), "version": m.get("version"), "tool": m.get("tool", ""), "created_ns": _ns(m["created_at"]), "hash": m.get("hash"), "chunker": m.get("chunker") or {}, "model": dict(m.get("model") or {}), "files": []}
    out["model"]["digest"] = clean(out["model"].get("digest"))
    for f in m.get("files") or []:
        if f is None:
            raise ValueError("null file entry")
        chunks = [{"offset": c["offset"], "length": c["length"], "digest": clean(c["digest"])} for c in f.get("chunks") or []]
        out["files"].append({"path": f["path"], "size": f["size"], "mode": f.get("mode", 0), "mtime_ns": _ns(f["mod_time"]), "role": f.get("role") or "other", "digest": clean(f.get("digest")), "chunker": f.get("chunker") or {}, "chunks": chunks})
    return out


def _bad(text: str):
    raise ValueError(f"not a digest: {text!r}")


def decode(data: bytes, dialect: Dialect = Dialect()) -> dict:
    """Either encoding, told by the first bytes."""
    return decode_binary(data, dialect) if data[:4] == dialect.magic else decode_json(data.decode())


def load(path: str, dialect: Dialect = Dialect()) -> dict:
    """A manifest of a file, or of standard input for "-". Errors name the path."""
    if path == "-":
        return decode(sys.stdin.buffer.read(), dialect)
    try:
        with open(path, "rb") as f:
            return decode(f.read(), dialect)
    except (ValueError, KeyError, TypeError) as x:
        raise ValueError(f"{path}: {x}") from x


def save(path: str, m: dict, encoding: Encoding = Encoding.AUTO, dialect: Dialect = Dialect()) -> None:
    """Writes beside the target, syncs and renames; "-" is standard output (JSON unless binary is asked)."""
    if encoding is Encoding.AUTO:
        encoding = Encoding.JSON if path == "-" else encoding_for_path(path)
    data = encode_binary(m, dialect) if encoding is Encoding.BINARY else encode_json(m).encode()
    if path == "-":
        if encoding is Encoding.BINARY and sys.stdout.isatty():
            raise ValueError("binary manifest to a terminal")
        sys.stdout.buffer.write(data)
        return
    atomic_write(path, data)


def atomic_write(path: str, data: bytes) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder, prefix=".manifest-")
    try:
        with io.open(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temp, 0o644)
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def state_path(root: str, *parts: str, state: str = STATE_DIR) -> str:
    return os.path.join(root, state, *parts)


def load_applied(root: str, dialect: Dialect = Dialect()) -> dict:
    """The manifest that was last applied to root."""
    return load(state_path(root, MANIFEST_NAME), dialect)
