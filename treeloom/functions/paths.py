"""Slash-separated relative paths."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.schemas import STATE_DIR


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """With its last slash; empty for a path without one."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)))


def extension(path: Column) -> Column:
    """From the last dot of the basename on, the dot included; empty without a dot."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)\z", 1)


def path_problem(path: str, state_dir: str = STATE_DIR) -> str | None:
    """Why a manifest may not hold this path, or None."""
    if not path:
        return "empty path"
    if path.startswith("/"):
        return "absolute path"
    if "\\" in path:
        return "backslash in path"
    if path != posixpath.normpath(path):
        return "unclean path"
    if path == ".." or path.startswith("../"):
        return "path escapes root"
    if path == state_dir or path.startswith(state_dir + "/"):
        return "path inside state folder"
    return "NUL in path" if "\0" in path else None


def path_problem_column(path: Column, state_dir: str = STATE_DIR) -> Column:
    # an empty or "." part, or ".." after a part that is not ".."
    unclean = (path != ".") & path.rlike(r"//|/\z|(\A|/)\.(/|\z)|(\A|/)(?!\.\.(/|\z))[^/]+/\.\.(/|\z)")
    return (
        F.when(path.isNull() | (path == ""), "empty path")
        .when(path.startswith("/"), "absolute path")
        .when(F.contains(path, F.lit("\\")), "backslash in path")
        .when(unclean, "unclean path")
        .when((path == "..") | path.startswith("../"), "path escapes root")
        .when((path == state_dir) | path.startswith(state_dir + "/"), "path inside state folder")
        .when(F.contains(path, F.lit("\0")), "NUL in path")
    )


def glob_regex(pattern: str) -> str | None:
    """An anchored regex of a glob whose stars stay within a path part; None if it is malformed."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end, first = i, True
            negated = pattern[i : i + 1] == "^"
            end = i + negated
            items = []
            while end < len(pattern) and (pattern[end] != "]" or first):
                first = False
                if pattern[end] == "\\":
                    end += 1
                    if end >= len(pattern):
                        return None
                items.append("-" if pattern[end] == "-" and items and end + 1 < len(pattern) and pattern[end + 1] != "]" else re.escape(pattern[end]))
                end += 1
            if end >= len(pattern) or not items:
                return None
            out.append(f"[{'^/' if negated else ''}{''.join(items)}]")
            i = end + 1
        elif c == "\\":
            if i >= len(pattern):
                return None
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c))
    try:
        re.compile(made := rf"\A(?:{''.join(out)})\Z")
    except re.error:
        return None
    return made


def display_name(root: str) -> str:
    base = root.rstrip("/").replace("\\", "/").rsplit("/", 1)[-1]
    if base in ("", "."):
        return ""
    return base.removeprefix("models--").replace("--", "/") if base.startswith("models--") else base


def display_name_column(root: Column) -> Column:
    base = basename(F.replace(F.regexp_replace(root, r"/+\z", ""), F.lit("\\"), F.lit("/")))
    return F.when(base.isin("", "."), "").when(base.startswith("models--"), F.replace(F.substring(base, F.lit(9), F.length(base)), F.lit("--"), F.lit("/"))).otherwise(base)
