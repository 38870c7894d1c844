"""Applying a plan: assemble, verify, replace, delete, record."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.chunking import Options as ChunkOptions
from treeloom.functions.chunking import guessed_role, options_column
from treeloom.manifests import Manifest
from treeloom.operators.layout import role_rank
from treeloom.plans import delta
from treeloom.runtime import cut, prepare
from treeloom.schemas import CHUNKS, MANIFEST_NAME, STAGE_DIR, STATE_DIR
from treeloom.sources import codec, tree

RESULTS = "path string, temp string, received_bytes long, reused_bytes long, error string"
#: Bytes of chunks that are digested side by side, and source files that a task keeps open.
TOGETHER, OPEN = 8 << 20, 8
#: What the stage holds of a file: .part when a task got to its end, .attempt while it writes or was killed.
STAGED = r"\.(?:part|[0-9a-f]{32}\.attempt)$"


def require_apart(source: str, dest: str) -> None:
    """Neither tree may be the other or lie within it. (A nested folder whose name starts with a dot counts.)"""
    a, b = Path(source).resolve(), Path(dest).resolve()
    if a == b or a in b.parents or b in a.parents:
        raise ValueError(f"source and destination overlap: {source}, {dest}")


def stage_root(dest: str) -> str:
    return os.path.join(dest, STATE_DIR, STAGE_DIR)


def inspect(spark: SparkSession, wanted: Manifest, dest: str, options: delta.Options, pin: ChunkOptions | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(destination files, their chunks, staged chunks). Only candidates are read. Nothing is written; a
    destination that is not there is empty. A file of the manifest that can't be read fails the plan."""
    if not os.path.isdir(dest):
        none = spark.createDataFrame([], "path string, size long, mode int, mtime_ns long")
        return none.withColumn("digest", F.lit(None).cast("binary")), spark.createDataFrame([], CHUNKS), None
    found = cut(tree.entries(tree.scan(spark, dest, hidden=True, follow=False)), "dest")
    ask = delta.candidates(found, wanted.files, options)
    sizes = wanted.files.select("path", "chunker")
    guess = options_column(guessed_role(F.col("size")), F.col("size"), pin)
    own = ask.join(sizes, "path", "left").select("path", "size", *[F.coalesce(F.when(F.col(f"chunker.{k}") > 0, F.col(f"chunker.{k}")), guess[k]).alias(k) for k in ("avg_size", "min_size", "max_size")])
    hashed = cut(tree.hash_files(own, dest, algorithm=wanted.algorithm), "dest-hashed")
    failed = hashed.filter("error is not null").join(wanted.files.select("path"), "path", "left_semi").select("path", "error").head()
    if failed:
        raise OSError(f"cannot read {failed['path']} at the destination: {failed['error']}")
    files = found.join(hashed.filter("chunk_idx = -1 and error is null").select("path", "digest"), "path", "left")
    staged = None
    if options.resume and os.path.isdir(stage_root(dest)):
        parts = tree.entries(tree.scan(spark, stage_root(dest), hidden=True, follow=False)).filter(F.col("path").rlike(STAGED))
        parts = parts.select(F.col("path").alias("file"), F.regexp_replace("path", STAGED, "").alias("path"), "size")
        whole = wanted.files.select("path", "size", *[F.col(f"chunker.{k}").alias(k) for k in ("avg_size", "min_size", "max_size")]).join(parts, ["path", "size"])
        rows = tree.hash_files(whole.drop("path").withColumnRenamed("file", "path"), stage_root(dest), algorithm=wanted.algorithm, whole=False)
        rows = rows.filter("error is null").select(F.regexp_replace("path", STAGED, "").alias("path"), F.col("path").alias("file"), "offset", "length", "digest")
        staged = cut(delta.staged_chunks(rows, wanted.chunks), "staged")
    return files, hashed.filter("chunk_idx >= 0 and error is null").drop("error"), staged


def make_plan(spark: SparkSession, wanted: Manifest, dest: str, options: delta.Options, pin: ChunkOptions | None = None) -> delta.Plan:
    wanted.validate()
    return delta.plan(wanted.files, wanted.chunks, *inspect(spark, wanted, dest, options, pin), options)


def _sync(path: Path | str) -> None:
    """Makes a file, or a folder's entries, durable."""
    at = os.open(path, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


class _Sources:
    """Open files to read ranges of; the OPEN used last stay open."""

    def __init__(self) -> None:
        self.files: dict[Path, object] = {}

    def read(self, path: Path, offset: int, length: int) -> bytes:
        f = self.files.pop(path, None) or open(path, "rb")  # noqa: SIM115
        self.files[path] = f
        if len(self.files) > OPEN:
            self.files.pop(next(iter(self.files))).close()
        f.seek(offset)
        return f.read(length)

    def close(self) -> None:
        while self.files:
            self.files.popitem()[1].close()


class _Assembly:
    """One file that a task puts together, under a name that no other attempt shares, in place from its first
    byte: what a killed task has written serves the next run."""

    def __init__(self, path: str, stage: str, size: int, whole: bytes, algorithm: str, verify: bool):
        self.path, self.stage, self.size, self.whole, self.algorithm, self.verify = path, stage, size, whole, algorithm, verify
        final = Path(stage, path)
        final.parent.mkdir(parents=True, exist_ok=True)
        self.temp = f"{final}.{uuid.uuid4().hex}.attempt"
        self.out = open(self.temp, "wb")  # noqa: SIM115
        self.out.truncate(size)
        self.sources, self.held, self.bytes, self.got, self.reused, self.error = _Sources(), [], 0, 0, 0, None

    def add(self, name: Path, at: int, row) -> None:
        if self.error is None:
            try:
                self.held.append((self.sources.read(name, at, int(row.length)), name, int(row.offset), bytes(row.digest), row.sent))
                self.bytes += int(row.length)
            except OSError as x:
                self.error = str(x.strerror)
            if self.bytes >= TOGETHER:
                self.write()

    def write(self) -> None:
        """Writes what is held and has its digest."""
        held, self.held, self.bytes = self.held, [], 0
        for (data, name, offset, want, sent), digest in zip(held, tree.digest_many([h[0] for h in held], self.algorithm), strict=True):
            if digest != want:
                self.error = self.error or f"{name} changed since planning"
                continue
            self.out.seek(offset)
            self.out.write(data)
            if sent:
                self.got += len(data)
            else:
                self.reused += len(data)

    def finish(self) -> tuple:
        """A row of RESULTS."""
        self.write()
        self.sources.close()
        self.out.flush()
        os.fsync(self.out.fileno())
        self.out.close()
        if self.error is None and self.verify:
            own, n = tree.digester(self.algorithm), 0
            with open(self.temp, "rb") as f:
                while part := f.read(4 << 20):
                    own.update(part)
                    n += len(part)
            if n != self.size or own.digest() != self.whole:
                self.error = "the assembled file does not match its digest"
        final = Path(self.stage, self.path + ".part")
        os.replace(self.temp, final)  # what is right of it serves a later run
        return self.path, str(final), self.got, self.reused, self.error


def assemble(p: delta.Plan, wanted: Manifest, source: str, dest: str, verify: bool = True) -> DataFrame:
    """RESULTS of each file that is not skipped: the whole file under a temporary name, each chunk checked
    before it is written and (with verify) the whole again after. One task owns a file; chunks come in order.

    Chunks that the destination holds are read there; needed ones, and ones that an earlier file of the
    same run brings, from the source. A task that is repeated writes under a name of its own.
    """
    prepare(p.files.sparkSession)
    stage, algorithm = stage_root(dest), wanted.algorithm
    at = delta.best_locations(p.chunks.filter("not need").select("path", "chunk_idx", "digest"), p.locations)
    chunks = p.chunks.join(at.drop("digest"), ["path", "chunk_idx"], "left")
    sent = p.chunks.filter("need").select("path", "digest").distinct().withColumn("_sent", F.lit(True))
    chunks = chunks.join(sent, ["path", "digest"], "left").select("path", "chunk_idx", "offset", "length", "digest", F.coalesce("_sent", F.lit(False)).alias("sent"), "src_path", "src_offset", "origin")
    files = p.work.select("path", "size").join(wanted.files.select("path", F.col("digest").alias("whole")), "path")
    rows = files.join(chunks, "path", "left").repartition(F.col("path")).sortWithinPartitions("path", "offset")
    names = [c.split()[0] for c in RESULTS.split(", ")]

    def run(batches):
        now = None
        for b in batches:
            done = []
            for r in b.itertuples(index=False):
                if now is None or now.path != r.path:
                    if now:
                        done.append(now.finish())
                    now = _Assembly(r.path, stage, int(r.size), bytes(r.whole), algorithm, verify)
                if r.offset is None or pd.isna(r.offset):
                    continue
                if r.sent or not isinstance(r.src_path, str):
                    now.add(Path(source, r.path), int(r.offset), r)
                else:
                    now.add(Path(stage if r.origin == "staged" else dest, r.src_path), int(r.src_offset), r)
            if done:
                yield pd.DataFrame(done, columns=names)
        if now:
            yield pd.DataFrame([now.finish()], columns=names)

    return rows.mapInPandas(run, RESULTS)


def prune_empty(folder: Path, stop: Path) -> None:
    """Removes empty folders from folder upwards, never stop or above it."""
    while folder != stop and stop in folder.parents:
        try:
            folder.rmdir()
        except OSError:
            return
        folder = folder.parent


def clean_stage(dest: str, whole: bool) -> None:
    """Removes empty stage folders, deepest first, and, if whole, what attempts left; parts of interrupted files stay
    otherwise."""
    top = stage_root(dest)
    for folder, _, names in os.walk(top, topdown=False):
        for name in names if whole else ():
            if re.search(STAGED, name):
                Path(folder, name).unlink(missing_ok=True)
        try:
            os.rmdir(folder)
        except OSError:
            continue


def apply(spark: SparkSession, wanted: Manifest, source: str, dest: str, options: delta.Options = delta.Options(), *, pin: ChunkOptions | None = None, preserve_times: bool = True, dry_run: bool = False, verify: bool = True) -> dict:
    """Makes dest hold the wanted files. Returns totals, errors by path and warnings.

    Files are replaced in transfer order after they have been verified; with atomic "model" only if all
    were. Contents and names are synced to disk. Extra files are deleted if asked, hidden and excluded ones too, as
    the plan lists them. That the manifest can't be recorded at the destination is a warning only.
    """
    require_apart(source, dest)
    p = make_plan(spark, wanted, dest, options, pin)
    p = delta.Plan(cut(p.files, "plan-files"), cut(p.chunks, "plan-chunks"), cut(p.deletes, "plan-deletes"), cut(p.locations, "plan-locations"))
    out = p.totals.first().asDict()
    if dry_run:
        return out | {"errors": {}, "warnings": []}
    os.makedirs(dest, exist_ok=True)
    results = cut(assemble(p, wanted, source, dest, verify), "results")
    meta = wanted.files.select("path", "mode", "mtime_ns", role_rank(F.col("role")).alias("_rank"))
    errors = {r["path"]: r["error"] for r in results.filter("error is not null").toLocalIterator()}
    written, folders = 0, set()
    if not (errors and options.atomic == "model"):
        for r in results.filter("error is null").join(meta, "path").orderBy("_rank", "path").toLocalIterator():
            final = Path(dest, r["path"])
            final.parent.mkdir(parents=True, exist_ok=True)
            os.chmod(r["temp"], (r["mode"] or 0) & 0o7777 or 0o644)
            if preserve_times:
                os.utime(r["temp"], ns=(r["mtime_ns"], r["mtime_ns"]))
            os.replace(r["temp"], final)
            folders.add(final.parent)
            written += 1
    for folder in folders:
        _sync(folder)
    sums = results.filter("error is null").agg(F.coalesce(F.sum("received_bytes"), F.lit(0)), F.coalesce(F.sum("reused_bytes"), F.lit(0))).first()
    out |= {"written_files": written, "received_bytes": sums[0], "reused_bytes": sums[1], "deleted_files": 0, "errors": errors, "warnings": []}
    if not errors:
        for r in p.deletes.toLocalIterator():
            gone = Path(dest, r["path"])
            gone.unlink(missing_ok=True)
            prune_empty(gone.parent, Path(dest))
            out["deleted_files"] += 1
        m = wanted.as_dict()
        m["model"] = {**m["model"], "root": dest}
        try:
            codec.save(codec.state_path(dest, MANIFEST_NAME), m)
        except OSError as x:
            out["warnings"].append(f"the manifest could not be recorded: {x.strerror}")
    clean_stage(dest, not errors)
    return out
