"""A tree against its manifest: problems, extra files, damaged ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stat_problems(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem, want_size, got_size, error from metadata alone: missing, unreadable or size-mismatch.

    found: path, size, error (why it can't be read, else null). Only files without such a problem have to
    be read: their problem is null."""
    f = found.select("path", F.col("size").alias("got_size"), "error", F.lit(True).alias("_there"))
    both = wanted.select("path", F.col("size").alias("want_size"), "digest").join(f, "path", "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(F.col("error").isNotNull(), "unreadable").when(F.col("got_size") != F.col("want_size"), "size-mismatch")
    return both.select("path", "digest", problem.alias("problem"), "want_size", F.coalesce("got_size", F.lit(0)).alias("got_size"), "error")


def digest_problems(checked: DataFrame, digests: DataFrame) -> DataFrame:
    """path, problem, want_size, got_size, want, got, error of all files with a problem.

    digests: path, got (digest), error of the files that were read."""
    both = checked.withColumnRenamed("error", "_e").join(digests.select("path", "got", F.col("error").alias("_read")), "path", "left")
    problem = F.coalesce(F.col("problem"), F.when(F.col("_read").isNotNull(), "unreadable").when(~F.col("got").eqNullSafe(F.col("digest")), "digest-mismatch"))
    return both.select("path", problem.alias("problem"), "want_size", "got_size", F.col("digest").alias("want"), "got", F.coalesce("_e", "_read").alias("error")).filter("problem is not null")


def bad_chunks(chunks: DataFrame, failing: DataFrame, found: DataFrame) -> DataFrame:
    """path, chunk_idx, offset, length, want, got, error of the failing files' ranges whose digest differs.

    found: path, chunk_idx, got, error: what those ranges hold now."""
    own = chunks.join(failing.select("path"), "path", "left_semi")
    both = own.join(found.select("path", "chunk_idx", "got", "error"), ["path", "chunk_idx"], "left")
    return both.filter(F.col("error").isNotNull() | ~F.col("got").eqNullSafe(F.col("digest"))).select("path", "chunk_idx", "offset", "length", F.col("digest").alias("want"), "got", "error")


def extra_files(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    return entries.select("path").join(wanted.select("path"), "path", "left_anti")


def verify_totals(wanted: DataFrame, problems: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """One row: files, files_ok, bytes_checked, bad_bytes."""
    unread = problems.filter(F.col("problem").isin("missing", "size-mismatch")).select("path").withColumn("_unread", F.lit(True))
    wrong = problems.select("path").withColumn("_wrong", F.lit(True))
    both = wanted.select("path", "size").join(unread, "path", "left").join(wrong, "path", "left")
    out = both.agg(F.count("*").alias("files"), F.count_if(F.col("_wrong").isNull()).alias("files_ok"), F.coalesce(F.sum(F.when(F.col("_unread").isNull(), F.col("size"))), F.lit(0)).alias("bytes_checked"))
    if bad is None:
        return out.withColumn("bad_bytes", F.lit(0).cast("long"))
    return out.join(bad.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bad_bytes")))
