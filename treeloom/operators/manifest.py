"""Totals, summaries and validation of a manifest's files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.paths import path_problem_column
from treeloom.schemas import CHUNKER_NAME, STATE_DIR


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"))


def total_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks"))


def first_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """digest and length of each digest's first chunk in order; combined before the shuffle."""
    return chunks.groupBy("digest").agg(F.min_by("length", F.struct(*order)).alias("length"))


def unique_chunks(chunks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """unique_chunks, unique_bytes: each digest once, with the length at its first occurrence."""
    first = first_chunks(chunks, order or ["path", "chunk_idx"])
    return first.agg(F.count("*").alias("unique_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("unique_bytes"))


def digest_lengths(chunks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """digest, length: at the digest's last occurrence."""
    return chunks.groupBy("digest").agg(F.max_by("length", F.struct(*(order or ["path", "chunk_idx"]))).alias("length"))


def model_summary(files: DataFrame, *keys: str) -> DataFrame:
    """files, size, weight_files, weight_bytes of a tree, or of each tree of keys."""
    weight = F.col("role") == "weight"
    return files.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        F.count_if(weight).alias("weight_files"),
        F.coalesce(F.sum(F.when(weight, F.col("size"))), F.lit(0)).alias("weight_bytes"),
    )


def manifest_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, bytes, weights, chunks, unique chunks and bytes, dedup ratio."""
    out = model_summary(files).join(total_chunks(chunks)).join(unique_chunks(chunks))  # one row each
    return out.withColumn("dedup_ratio", F.when(F.col("size") == 0, 0.0).otherwise(1 - F.col("unique_bytes") / F.col("size")))


def running_offsets(chunks: DataFrame) -> DataFrame:
    """chunks with the offset that their lengths imply."""
    before = Window.partitionBy("path").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """path, chunk_idx, problem: chunks that don't start where the one before ends, or are empty."""
    before = Window.partitionBy("path").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    want = F.coalesce(F.sum("length").over(before), F.lit(0))
    problem = F.when(F.col("offset") != want, "not contiguous").when(F.col("length") == 0, "zero length")
    return chunks.select("path", "chunk_idx", problem.alias("problem")).filter("problem is not null")


def coverage_violations(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, size, covered of files whose chunks don't add up to their size."""
    covered = chunks.groupBy("path").agg(F.sum("length").alias("covered"))
    out = files.select("path", "size").join(covered, "path", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.filter(F.col("covered") != F.col("size"))


def duplicate_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")


def path_violations(files: DataFrame, state_dir: str = STATE_DIR) -> DataFrame:
    return files.select("path", path_problem_column(F.col("path"), state_dir).alias("problem")).filter("problem is not null")


def violations(files: DataFrame, chunks: DataFrame, chunker: str = CHUNKER_NAME) -> DataFrame:
    """path, problem: everything for which a manifest's tables are not to be trusted. Empty if they are."""
    own = files.select(
        "path",
        F.when(F.col("size") < 0, "negative size").when(~F.col("chunker.algorithm").isin("", chunker), "unsupported chunker").alias("problem"),
    ).filter("problem is not null")
    return (
        path_violations(files)
        .union(own)
        .union(duplicate_paths(files).select("path", F.lit("duplicate path")))
        .union(chunk_violations(chunks).select("path", "problem"))
        .union(coverage_violations(files, chunks).select("path", F.lit("chunks do not cover the file")))
    )


def require_valid(files: DataFrame, chunks: DataFrame, chunker: str = CHUNKER_NAME) -> None:
    bad = violations(files, chunks, chunker).orderBy("path", "problem").take(5)
    if bad:
        raise ValueError("invalid manifest: " + "; ".join(f"{r['path']!r}: {r['problem']}" for r in bad))
