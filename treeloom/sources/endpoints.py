"""Where a tree is: a local path, or one on another host."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Endpoint:
    scheme: str
    path: str
    host: str = ""
    user: str = ""
    port: int = 0

    @property
    def is_local(self) -> bool:
        return self.scheme == "file"

    @property
    def local_path(self) -> str:
        if not self.is_local or not self.path.strip():
            raise ValueError(f"{self} is not a local path")
        return posixpath.normpath(self.path)

    def __str__(self) -> str:
        if self.is_local:
            return self.path
        user, port = f"{self.user}@" if self.user else "", f":{self.port}" if self.port else ""
        return f"ssh://{user}{self.host}{port}/{self.path.removeprefix('/')}"


def parse_endpoint(text: str) -> Endpoint:
    """"host:/path" is remote; "./a:b" and "/a:b" are not."""
    raw = text.strip()
    if not raw:
        raise ValueError("empty path")
    if m := re.match(r"(?i)(ssh|file)://", raw):
        rest = raw[m.end() :]
        return Endpoint("file", rest) if m[1].lower() == "file" else _ssh(raw, rest)
    where, colon, path = raw.partition(":")
    if colon and where and path and raw[0] not in "./" and "/" not in where and "\\" not in where:
        user, _, host = where.rpartition("@")
        return Endpoint("ssh", path, host, user)
    return Endpoint("file", raw)


def _ssh(raw: str, rest: str) -> Endpoint:
    authority, slash, path = rest.partition("/")
    user, _, host = authority.rpartition("@")
    port = 0
    if ":" in host:
        host, _, number = host.rpartition(":")
        if not re.fullmatch(r"[+-]?\d+", number) or not 0 < int(number) < 65536:
            raise ValueError(f"{raw!r} has an invalid port")
        port = int(number)
    if not host:
        raise ValueError(f"{raw!r} has no host")
    if not slash:
        raise ValueError(f"{raw!r} has no path")
    return Endpoint("ssh", "/" + path, host, user, port)
