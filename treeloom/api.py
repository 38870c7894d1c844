"""The commands as functions."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.manifests import Manifest, build, from_dict
from treeloom.operators import diff as diffs
from treeloom.operators import verify as checks
from treeloom.plans import apply as applying
from treeloom.plans.delta import Options
from treeloom.runtime import cut
from treeloom.sources import codec, tree

build_manifest = build


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    """Of a file in either encoding, or of a tree to which one was applied."""
    return from_dict(spark, codec.load_applied(path) if os.path.isdir(path) else codec.load(path))


def save_manifest(m: Manifest, path: str, encoding: codec.Encoding = codec.Encoding.AUTO) -> None:
    codec.save(path, m.as_dict(), encoding)


def diff(old: Manifest | None, new: Manifest) -> tuple[DataFrame, DataFrame]:
    """(rows by path, one row of totals). No old manifest is an empty one."""
    files = old.files if old else new.files.limit(0)
    chunks = old.chunks if old else new.chunks.limit(0)
    rows = cut(diffs.file_diffs(files, chunks, new.files, new.chunks), "diff")
    return rows.orderBy("path"), diffs.diff_totals(rows)


def copy(spark: SparkSession, source: str, dest: str, options: Options = Options(), *, manifest: str | None = None, manifest_format: codec.Encoding = codec.Encoding.AUTO, **how) -> dict:
    """Brings dest to the source's state; how goes to build or apply. An empty source is an error. manifest: a
    file to which the source's manifest is written before."""
    build_keys = {k: how.pop(k) for k in ("pin", "algorithm", "hidden", "follow", "exclude", "name", "warnings") if k in how}
    applying.require_apart(source, dest)
    m = build(spark, source, **build_keys)
    if not m.model["files"]:
        raise ValueError(f"{source} holds no files")
    if manifest:
        save_manifest(m, manifest, manifest_format)
    return applying.apply(spark, m, source, dest, options, pin=build_keys.get("pin"), **how)


def sync(spark: SparkSession, source: str, dest: str, options: Options = Options(delete=True), **how) -> dict:
    return copy(spark, source, dest, options, **how)


def verify(spark: SparkSession, root: str, manifest: Manifest | None = None, *, quick: bool = False, extra: bool = False) -> dict[str, DataFrame]:
    """problems, bad_chunks, extra, totals. Files that are missing or have another size are not read, and
    chunks are looked at only in files whose digest is wrong (not at all if quick). What is there and can't be
    looked at (an entry without rights, say) is unreadable; extra files are listed without following links."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    m = (manifest or load_manifest(spark, root)).validate()
    found = cut(tree.scan(spark, root, hidden=True, follow=True), "found")
    denied = F.col("warning").startswith(tree.UNREADABLE)
    found = found.filter("warning is null").select("path", "size", F.lit(None).cast("string").alias("error")).union(found.filter(denied).select("path", "size", F.expr(f"substring(warning, {len(tree.UNREADABLE) + 1})")))
    checked = cut(checks.stat_problems(m.files, found), "checked")
    read = checked.filter("problem is null").select("path", F.col("want_size").alias("size"))
    problems = cut(checks.digest_problems(checked, tree.digest_files(read, root, m.algorithm)), "problems")
    failing = problems.filter("problem = 'digest-mismatch'")
    if quick:
        failing = failing.limit(0)
    ranges = m.chunks.join(failing.select("path"), "path", "left_semi")
    bad = cut(checks.bad_chunks(m.chunks, failing, tree.digest_ranges(ranges, root, m.algorithm)), "bad")
    out = {"problems": problems.orderBy("path"), "bad_chunks": bad.orderBy("path", "chunk_idx"), "totals": checks.verify_totals(m.files, problems, bad)}
    listed = tree.entries(tree.scan(spark, root, hidden=True, follow=False))
    out["extra"] = checks.extra_files(listed, m.files).orderBy("path") if extra else listed.select("path").limit(0)
    return out
