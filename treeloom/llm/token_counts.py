"""Token counts: map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.pieces import CACHE_CHARS, Cache, chunks, tokenizer
from treeloom.runtime import prepare

#: Rows of a partition from which pre-tokens are counted, the partitions at most from which, and entries of the
#: first tier. Entries have at most CACHE_CHARS characters, so the table stays below TABLE_BYTES.
SAMPLE_ROWS, SAMPLE_PARTS, FREQUENT = 256, 64, 50_000
TABLE_BYTES = FREQUENT * (4 * CACHE_CHARS + 8)

_caches: dict[str, Cache] = {}


def frequent_lengths(docs: DataFrame, tokenizer_path: str, *, text: str = "text") -> dict[str, int]:
    """First tier: the most frequent pre-tokens of a bounded sample of docs, with their token counts.

    The sample is the whole texts of the first SAMPLE_ROWS rows of SAMPLE_PARTS partitions, which are spread
    over the table. They are counted in each task, summed by pre-token, and of those that occur again the
    FREQUENT most frequent come to the driver. The sample settles which pre-tokens need no encoding, not any count.
    """
    parts = docs.rdd.getNumPartitions()
    step = max(1, parts // SAMPLE_PARTS)

    def count(batches):
        counts: Counter[str] = Counter()
        left = SAMPLE_ROWS
        for b in batches:
            for t in b.iloc[:left, 0]:
                if t:
                    counts.update(c for c in chunks(t)[1] if len(c) <= CACHE_CHARS)
            left -= len(b)
            if left <= 0:
                break
        yield pd.DataFrame({"chunk": list(counts), "n": list(counts.values())}).astype({"chunk": "object", "n": "int64"})

    some = docs.select(text).filter((F.spark_partition_id() % step == 0) & (F.spark_partition_id() < step * SAMPLE_PARTS))
    most = some.mapInPandas(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "chunk").limit(FREQUENT)
    found = [r[0] for r in most.collect()]
    encoded = tokenizer(tokenizer_path).encode_batch([c if c[:1] == "\n" else " " + c for c in found], add_special_tokens=False)
    table = {c: len(e.ids) for c, e in zip(found, encoded, strict=True)}
    if sum(len(c.encode("utf-8", "surrogatepass")) + 8 for c in table) > TABLE_BYTES:
        raise ValueError("the table of frequent pre-tokens is larger than its bound")
    return table


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs.

    No row moves: each task looks pre-tokens up in the broadcast table of frequent lengths, then in its
    worker's bounded cache, and encodes what neither holds. Null text counts as empty, repeated rows are
    counted each, an empty table gives an empty result, and other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text=text))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _caches.get(tokenizer_path)
        if cache is None or cache.frequent is not table.value:
            cache = _caches[tokenizer_path] = Cache(tokenizer_path, len, table.value)
        for texts in batches:
            out = []
            for t in texts:
                if not t:
                    out.append(0)
                    continue
                first, rest = chunks(t)
                out.append(cache.alone(first) + sum(map(cache.__getitem__, rest)))
                cache.trim()
            yield pd.Series(out, dtype="int64")

    t = F.coalesce(docs[text], F.lit(""))
    out = docs.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), n_tokens(t).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
