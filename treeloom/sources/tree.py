"""Directory trees as tables: entries, file digests, chunks, ranges.

Trees are read by executors through paths that all of them see (a shared mount). Contents never enter a
column: tasks stream files and give back offsets, lengths and digests.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeloom.functions.chunking import Options, options_for, read_chunks
from treeloom.functions.hashing import Blake3, blake3_many
from treeloom.functions.paths import glob_regex
from treeloom.runtime import prepare
from treeloom.schemas import STATE_DIR

#: Subtrees that the driver looks for before it deals them out, and file bytes that one task reads.
SUBTREES, TASK_BYTES = 64, 256 << 20
#: How the warning of an entry begins whose metadata can't be read; the reason follows.
UNREADABLE = "unreadable: "
HASHED = "path string, chunk_idx int, offset long, length long, digest binary, error string"


class _Subtree(InputPartition):
    """Folders to be walked wholly, and folders of which only the files count."""

    def __init__(self, deep: list[str], flat: list[str]):
        self.deep, self.flat = deep, flat


class TreeSource(DataSource):
    """spark.read.format("tree").option("path", root): path, size, mode, mtime_ns and warning of the files below.

    Options: hidden, follow (links to files; default true), exclude (globs, one a line), state (name of
    state folders, which are skipped at any depth). Rows with a warning stand for what was left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size long, mode int, mtime_ns long, warning string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader({k.lower(): v for k, v in dict(self.options).items()})


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"].removeprefix("file://"))
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.follow = options.get("follow", "true").lower() == "true"
        self.state = options.get("state", STATE_DIR)
        globs = [glob_regex(g) for g in options.get("exclude", "").split("\n") if g]
        self.excluded = "|".join(f"(?:{g})" for g in globs if g)

    def _skips(self, rel: str, folder: bool) -> bool:
        base = rel.rsplit("/", 1)[-1]
        if folder and base == self.state or not self.hidden and base.startswith("."):
            return True
        return bool(self.excluded) and any(re.match(self.excluded, x) for x in (rel, base))

    def _listed(self, rel: str):
        """(folders, rows) directly below rel."""
        folders, rows = [], []
        with os.scandir(os.path.join(self.root, rel)) as found:
            for e in sorted(found, key=lambda e: os.fsencode(e.name)):
                path = f"{rel}/{e.name}" if rel else e.name
                folder = e.is_dir(follow_symlinks=False)
                if self._skips(path, folder):
                    continue
                if folder:
                    folders.append(path)
                    continue
                try:
                    s = e.stat(follow_symlinks=False)
                    if stat.S_ISLNK(s.st_mode):
                        if not self.follow:
                            rows.append((path, None, None, None, "left out, as links are not followed"))
                            continue
                        s = os.stat(e.path)
                        if stat.S_ISDIR(s.st_mode):
                            rows.append((path, None, None, None, "left out, a link to a folder"))
                            continue
                except FileNotFoundError:
                    rows.append((path, None, None, None, "left out, a link to nothing"))
                    continue
                except OSError as x:
                    rows.append((path, None, None, None, f"{UNREADABLE}{x.strerror}"))
                    continue
                if stat.S_ISREG(s.st_mode):
                    rows.append((path, s.st_size, stat.S_IMODE(s.st_mode), s.st_mtime_ns, None))
                else:
                    rows.append((path, None, None, None, "left out, neither file nor folder"))
        return folders, rows

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        flat, level = [""], self._listed("")[0]
        while level and len(level) < SUBTREES:
            below = [f for d in level for f in self._listed(d)[0]]
            if not below:
                break
            flat += level
            level = below
        return [_Subtree([], flat), *[_Subtree(level[k::SUBTREES], []) for k in range(min(SUBTREES, len(level)))]]

    def read(self, partition: _Subtree):
        for rel in partition.flat:
            yield from self._listed(rel)[1]
        todo = list(partition.deep)
        while todo:
            folders, rows = self._listed(todo.pop())
            yield from rows
            todo += folders


def scan(spark: SparkSession, root: str, *, hidden: bool = False, follow: bool = True, exclude: list[str] = (), state: str = STATE_DIR) -> DataFrame:
    """Rows of the tree source, warnings included."""
    prepare(spark)
    spark.dataSource.register(TreeSource)
    options = {"path": root, "hidden": str(hidden), "follow": str(follow), "exclude": "\n".join(exclude), "state": state}
    return spark.read.format("tree").options(**options).load()


def entries(scanned: DataFrame) -> DataFrame:
    return scanned.filter("warning is null").drop("warning")


def scan_warnings(scanned: DataFrame) -> DataFrame:
    return scanned.filter("warning is not null").select("path", "warning")


class _Sha256:
    def __init__(self):
        self.h = hashlib.sha256()
        self.update, self.digest = self.h.update, self.h.digest


def digester(algorithm: str):
    return {"blake3": Blake3, "sha256": _Sha256}[algorithm]()


def digest_many(parts: list[bytes], algorithm: str) -> list[bytes]:
    return blake3_many(parts) if algorithm == "blake3" else [hashlib.sha256(p).digest() for p in parts]


def dealt(files: DataFrame) -> DataFrame:
    """files dealt to tasks of about TASK_BYTES."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return files.repartition(max(1, min(n, -(-total // TASK_BYTES) + files.sparkSession.sparkContext.defaultParallelism)))


def hash_files(files: DataFrame, root: str, *, algorithm: str = "blake3", pin: Options | None = None, whole: bool = True) -> DataFrame:
    """path, chunk_idx, offset, length, digest, error: the chunks of each file, and in the row with chunk_idx -1
    its own digest and the size that was read (none if not whole).

    files: path, size, and role, or the chunker to use (avg_size, min_size, max_size). Files are streamed;
    the digests of many chunks are made side by side.
    """
    prepare(files.sparkSession)
    root = root.removeprefix("file://")
    given = "avg_size" in files.columns
    cols = ["path", "size", *(["avg_size", "min_size", "max_size"] if given else ["role"])]
    names = [c.split()[0] for c in HASHED.split(", ")]

    def run(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                if pin and pin.avg_size:
                    options = pin.normalized()
                elif given:
                    options = Options(int(f.avg_size or 0), int(f.min_size or 0), int(f.max_size or 0)).normalized()
                else:
                    options = options_for(f.role, int(f.size or 0))
                own, rows, parts, held, k, size = digester(algorithm), [], [], 0, 0, 0
                options.validate()
                try:
                    with open(Path(root, f.path), "rb") as file:
                        for offset, data in read_chunks(file.read, options):
                            if whole:
                                own.update(data)
                            rows.append((f.path, k, offset, len(data)))
                            parts.append(data)
                            held, k, size = held + len(data), k + 1, size + len(data)
                            if held > 8 << 20:
                                yield pd.DataFrame([(*r, d, None) for r, d in zip(rows, digest_many(parts, algorithm), strict=True)], columns=names)
                                rows, parts, held = [], [], 0
                    done = [(*r, d, None) for r, d in zip(rows, digest_many(parts, algorithm), strict=True)]
                    if whole:
                        done.append((f.path, -1, 0, size, own.digest(), None))
                except OSError as x:
                    done = [(f.path, -1, 0, 0, None, str(x.strerror))]
                if done:
                    yield pd.DataFrame(done, columns=names)

    return dealt(files.select(*cols)).mapInPandas(run, HASHED)


def digest_files(files: DataFrame, root: str, algorithm: str = "blake3") -> DataFrame:
    """path, got, size, error: the digest of each file as a whole, without chunks."""
    prepare(files.sparkSession)
    root = root.removeprefix("file://")

    def run(batches):
        for b in batches:
            rows = []
            for path in b["path"]:
                own, size = digester(algorithm), 0
                try:
                    with open(Path(root, path), "rb") as file:
                        while part := file.read(4 << 20):
                            own.update(part)
                            size += len(part)
                    rows.append((path, own.digest(), size, None))
                except OSError as x:
                    rows.append((path, None, size, str(x.strerror)))
            yield pd.DataFrame(rows, columns=["path", "got", "size", "error"])

    return dealt(files.select("path", "size")).mapInPandas(run, "path string, got binary, size long, error string")


def digest_ranges(ranges: DataFrame, root: str, algorithm: str = "blake3") -> DataFrame:
    """path, chunk_idx, got, error: the digest of each range (path, chunk_idx, offset, length); a short read is an
    error. Ranges of a file are read in order."""
    prepare(ranges.sparkSession)
    root = root.removeprefix("file://")

    def run(batches):
        for b in batches:
            rows, parts = [], []
            for r in b.itertuples(index=False):
                try:
                    with open(Path(root, r.path), "rb") as file:
                        file.seek(int(r.offset))
                        data = file.read(int(r.length))
                    if len(data) < r.length:
                        raise OSError(5, "short read")
                    rows.append((r.path, r.chunk_idx, len(parts), None))
                    parts.append(data)
                except OSError as x:
                    rows.append((r.path, r.chunk_idx, None, str(x.strerror)))
            done = digest_many(parts, algorithm)
            yield pd.DataFrame([(p, k, None if i is None else done[i], e) for p, k, i, e in rows], columns=["path", "chunk_idx", "got", "error"])

    own = ranges.select("path", "chunk_idx", "offset", "length").repartition(F.col("path")).sortWithinPartitions("path", "offset")
    return own.mapInPandas(run, "path string, chunk_idx int, got binary, error string")
