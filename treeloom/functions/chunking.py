"""Content-defined and fixed-size chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
#: Fixed bounds of options.
LEAST, MOST = 64, 1 << 30


@dataclass(frozen=True)
class Options:
    avg_size: int = 0
    min_size: int = 0
    max_size: int = 0

    def normalized(self) -> Options:
        avg = self.avg_size or 64 * KIB
        return Options(avg, self.min_size or avg // 4, self.max_size or avg * 4)

    def validate(self) -> Options:
        if self.min_size < LEAST or self.max_size > MOST or not self.min_size <= self.avg_size <= self.max_size:
            raise ValueError(f"chunk sizes out of order or bounds: {self}")
        return self


SMALL = Options(64 * KIB, 16 * KIB, 256 * KIB)
LARGE = Options(1 * MIB, 256 * KIB, 4 * MIB)
HUGE = Options(4 * MIB, 1 * MIB, 16 * MIB)


def options_for(role: str, size: int, pin: Options | None = None) -> Options:
    """The preset of a file, by role and size alone, so that both sides agree; a pin comes first."""
    if pin and pin.avg_size:
        return pin.normalized()
    if role != "weight" or size < 64 * MIB:
        return SMALL
    return HUGE if size >= GIB else LARGE


def options_column(role: Column, size: Column, pin: Options | None = None) -> Column:
    as_struct = lambda o: F.struct(*[F.lit(getattr(o, k)).cast("long").alias(k) for k in ("avg_size", "min_size", "max_size")])
    if pin and pin.avg_size:
        return as_struct(pin.normalized())
    weight = role.eqNullSafe(F.lit("weight"))
    return F.when(weight & (size >= GIB), as_struct(HUGE)).when(weight & (size >= 64 * MIB), as_struct(LARGE)).otherwise(as_struct(SMALL))


def guessed_role(size: Column) -> Column:
    """For files of which only the size is known."""
    return F.when(size >= 64 * MIB, "weight").otherwise("other")


def header_options(files: DataFrame, pin: Options | None = None) -> DataFrame:
    """One row: the preset of the largest weight file, the small one without weights."""
    largest = files.agg(F.max(F.when(F.col("role") == "weight", F.col("size"))).alias("largest"))
    return largest.select(options_column(F.when(F.col("largest").isNotNull(), "weight").otherwise("other"), F.coalesce("largest", F.lit(0)), pin).alias("chunker"))


def log2(v: int) -> int:
    return max(0, v.bit_length() - 1)


def low_mask(bits: int) -> int:
    return (1 << min(31, max(1, bits))) - 1


@lru_cache(8)
def gear_table(seed: int = 20_260_101) -> tuple[int, ...]:
    """256 random 32-bit numbers: by default our own, from a seed. A reader of others' chunks gives theirs."""
    x, out = seed, []
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        out.append((z ^ (z >> 31)) & 0xFFFFFFFF)
    return tuple(out)


def _rolling(data: np.ndarray, gear: np.ndarray, k: int) -> np.ndarray:
    """The low k bits of the hash at each place, as if it had begun k bytes or more before."""
    g = gear[data]
    h, reach = g.copy(), 1
    while reach < k:  # a sum of 2 * reach terms from two sums of reach terms
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h & np.uint32((1 << k) - 1)


def cut_points(data: bytes | np.ndarray, options: Options, gear: tuple[int, ...] | None = None, final: bool = True) -> list[int]:
    """Ends of the chunks of data. If more data follows (not final), a chunk is cut only where no later
    byte can matter, and the rest stays uncut.

    The hash starts anew at the least size of each chunk and each byte shifts it by one, so that its low k
    bits see k bytes alone. Places where they are zero are found for all of data at once; only the first k
    places of a chunk's search, which see less, are looked at one by one.
    """
    data = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    gear = gear or gear_table()
    table = np.array(gear, np.uint32)
    avg, low, high = options.avg_size, options.min_size, options.max_size
    small, large = low_mask(log2(avg) + 2), low_mask(log2(avg) - 2)
    k = small.bit_length()
    h = _rolling(data, table, k)
    strict, loose = np.flatnonzero(h & np.uint32(small) == 0), np.flatnonzero(h & np.uint32(large) == 0)
    out, start, n = [], 0, len(data)
    while start < n:
        left = n - start
        if not final and left < high:
            break
        if left <= low:
            out.append(n)
            break
        end = start + min(high, left)
        cut, x = end, 0
        warm = min(end, start + low + k)
        found = False
        for i in range(start + low, warm):
            x = (x << 1) + gear[data[i]] & 0xFFFFFFFF
            if not x & (small if i - start < avg else large):
                cut, found = i, True
                break
        if not found:
            middle = min(end, start + avg)
            if warm < middle:
                j = int(np.searchsorted(strict, warm))
                if j < len(strict) and strict[j] < middle:
                    cut, found = int(strict[j]), True
            if not found:
                j = int(np.searchsorted(loose, max(warm, middle)))
                if j < len(loose) and loose[j] < end:
                    cut = int(loose[j])
        out.append(cut)
        start = cut
    return out


def read_chunks(read, options: Options, gear: tuple[int, ...] | None = None, window: int = 8 * MIB) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the chunks of a stream; cuts depend on its bytes alone, not on the reads.
    Memory is bounded by the window and the greatest chunk."""
    options.validate()
    buffer, offset, window = bytearray(), 0, max(window, 2 * options.max_size)
    ended = False
    while not ended or buffer:
        while len(buffer) < window and not ended:
            part = read(window - len(buffer))
            ended = not part
            buffer += part
        start = 0
        for end in cut_points(bytes(buffer), options, gear, final=ended):
            yield offset + start, bytes(buffer[start:end])
            start = end
        del buffer[:start]
        offset += start


def fixed_chunks(files: DataFrame, column: str, size: int) -> DataFrame:
    """path, chunk_idx, offset, length, payload: pieces of size bytes of a binary column. JVM only."""
    n = F.octet_length(column)
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))))
    rows = files.select("path", F.col(column).alias("_d"), at.alias("chunk_idx"))
    piece = F.substring("_d", F.col("chunk_idx") * size + 1, F.lit(size))
    return rows.select("path", "chunk_idx", (F.col("chunk_idx") * F.lit(size)).cast("long").alias("offset"), F.octet_length(piece).cast("long").alias("length"), piece.alias("payload"))


@F.udtf(returnType=StructType([StructField("chunk_idx", IntegerType()), StructField("offset", LongType()), StructField("length", LongType()), StructField("payload", BinaryType())]))
class ContentChunks:
    """SELECT * FROM content_chunks(data, avg, min, max): content-defined chunks of a binary value."""

    def eval(self, data: bytes, avg_size: int, min_size: int, max_size: int):
        start = 0
        options = Options(avg_size, min_size, max_size).normalized().validate()
        for k, end in enumerate(cut_points(bytes(data or b""), options)):
            yield k, start, end - start, bytes(data[start:end])
            start = end


def register(spark) -> None:
    """Makes content_chunks() known to SQL."""
    spark.udtf.register("content_chunks", ContentChunks)


def content_chunks(files: DataFrame, column: str, options: Options, digest: str = "sha256", payload: bool = False) -> DataFrame:
    """path, chunk_idx, offset, length, digest (and payload): content-defined chunks of a column of bytes.

    Values are small enough for a cell; files are read by treeloom.sources.tree instead. Null has no chunks.
    """
    import hashlib

    import pandas as pd

    from treeloom.functions.hashing import blake3_many
    from treeloom.runtime import prepare

    prepare(files.sparkSession)
    options = options.normalized().validate()

    def run(batches):
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["data"], strict=True):
                data, start = bytes(data or b""), 0
                for k, end in enumerate(cut_points(data, options)):
                    rows.append((path, k, start, end - start, data[start:end]))
                    start = end
            pieces = [r[4] for r in rows]
            hashed = blake3_many(pieces) if digest == "blake3" else [hashlib.sha256(p).digest() for p in pieces]
            out = pd.DataFrame([(*r[:4], h) for r, h in zip(rows, hashed, strict=True)], columns=["path", "chunk_idx", "offset", "length", "digest"])
            yield out.assign(payload=pieces) if payload else out

    schema = "path string, chunk_idx int, offset long, length long, digest binary" + ", payload binary" * payload
    return files.select("path", F.col(column).cast("binary").alias("data")).mapInPandas(run, schema)
