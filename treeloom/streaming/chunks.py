"""Chunks as a stream: each digest once, and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_chunks(chunks: DataFrame, *, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each digest's first row of a streaming table of chunks. With a time column the state is bounded: a
    digest is forgotten once the watermark has passed it; without one every digest is kept."""
    if time is None:
        return chunks.dropDuplicates(["digest"])
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def running_totals(chunks: DataFrame, *, time: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """window, chunks, bytes of each window of a streaming table of chunks."""
    seen = chunks.withWatermark(time, delay).groupBy(F.window(time, window))
    return seen.agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"))
