"""What changed between two manifests, and what a holder of the old one lacks of the new one.

Files have path, size, digest and, in the new manifest, pos (their order; path order if it is missing);
chunks have path, chunk_idx, length, digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_chunks(old_chunks: DataFrame, new_chunks: DataFrame, order: list[str]) -> DataFrame:
    """path, length, is_new of each new chunk: it is new if the old manifest holds its digest nowhere, and
    charged to the digest's first occurrence in order. Repeats, and what the old one holds, are shared.

    The old digests go through a left join on the digest, so a digest in many chunks costs a sum, not a
    product; the first occurrence is a minimum, which is combined before it is shuffled.
    """
    known = old_chunks.select("digest").distinct().withColumn("_known", F.lit(True))
    first = new_chunks.groupBy("digest").agg(F.min(F.struct(*order)).alias("_first"))
    fresh = first.join(known, "digest", "left").filter(F.col("_known").isNull()).drop("_known")
    return new_chunks.join(fresh, "digest", "left").select("path", "length", F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False)).alias("is_new"))


def file_diffs(old_files: DataFrame, old_chunks: DataFrame, new_files: DataFrame, new_chunk_rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """path, change, old_size, new_size, shared_bytes, new_bytes, new_chunks of each path of either."""
    marked = new_chunks(old_chunks, new_chunk_rows, order or ["path", "chunk_idx"])
    by_path = marked.groupBy("path").agg(
        F.sum(F.when(F.col("is_new"), F.col("length")).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col("is_new"), 0).otherwise(F.col("length"))).alias("sb"),
        F.count_if(F.col("is_new")).alias("nc"),
    )
    a = old_files.select("path", F.col("size").alias("a_size"), F.col("digest").alias("a_digest"), F.lit(True).alias("a"))
    b = new_files.select("path", F.col("size").alias("b_size"), F.col("digest").alias("b_digest"), F.lit(True).alias("b"))
    both = a.join(b, "path", "full_outer").join(by_path, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    change = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(F.col("a_digest").eqNullSafe(F.col("b_digest")) & (F.col("a_size") == F.col("b_size")), "unchanged")
        .otherwise("modified")
    )
    return both.select("path", change.alias("change"), zero("a_size").alias("old_size"), zero("b_size").alias("new_size"), zero("sb").alias("shared_bytes"), zero("nb").alias("new_bytes"), zero("nc").alias("new_chunks"))


def diff_totals(diffs: DataFrame) -> DataFrame:
    """One row: counts by change, old, new, reusable and transfer bytes, identical, similarity."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = diffs.agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "unchanged")],
        total("old_size").alias("old_bytes"),
        total("new_size").alias("new_bytes"),
        total("shared_bytes").alias("reusable_bytes"),
        total("new_bytes").alias("transfer_bytes"),
    )
    out = out.withColumn("identical", (F.col("added") + F.col("removed") + F.col("modified")) == 0)
    return out.withColumn("similarity", F.when(F.col("new_bytes") == 0, 1.0).otherwise(F.col("reusable_bytes") / F.col("new_bytes")))


def top_changed(diffs: DataFrame, limit: int = 20) -> DataFrame:
    """Changed files, most new bytes first; limit 0 gives all."""
    out = diffs.filter("change <> 'unchanged'").orderBy(F.col("new_bytes").desc(), "path")
    return out.limit(limit) if limit else out
