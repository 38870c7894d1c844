import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.functions import chunking, hashing
from treeloom.functions.chunking import Options, cut_points, gear_table, log2, low_mask, options_for, read_chunks


def scalar(data: bytes, o: Options) -> list[int]:
    """The rule, one byte after the other."""
    gear, out, start = gear_table(), [], 0
    strict, loose = low_mask(log2(o.avg_size) + 2), low_mask(log2(o.avg_size) - 2)
    while start < len(data):
        left, h = len(data) - start, 0
        cut = min(o.max_size, left)
        if left > o.min_size:
            for i in range(o.min_size, cut):
                h = (h << 1) + gear[data[start + i]] & 0xFFFFFFFF
                if h & (strict if i < o.avg_size else loose) == 0:
                    cut = i
                    break
        start += cut
        out.append(start)
    return out


def test_cuts_follow_the_rule():
    r = random.Random(1)
    for _ in range(120):
        data = bytes(r.randrange(r.choice([2, 16, 256])) for _ in range(r.randrange(5000)))
        o = Options(r.choice([128, 256, 300, 500]), 64, r.choice([1024, 2000]))
        want = scalar(data, o)
        assert cut_points(data, o) == want
        file = io.BytesIO(data)
        got = list(read_chunks(lambda n, f=file: f.read(min(n, r.randrange(1, 400))), o, window=r.choice([64, 3000])))
        assert [a for a, _ in got] == [0, *want][: len(want)] and b"".join(p for _, p in got) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000), st.sampled_from([64, 128, 200]))
def test_chunks_cover_the_input(data, low):
    o = Options(4 * low, low, 16 * low)
    ends = cut_points(data, o)
    sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
    assert sum(sizes) == len(data) and all(0 < s <= o.max_size for s in sizes) and all(s >= low for s in sizes[:-1])


def test_most_chunks_survive_an_insertion():
    r = random.Random(3)
    data, o = r.randbytes(1 << 20), Options(4096, 1024, 16384)
    cuts = lambda d: {d[a:b] for a, b in zip([0, *cut_points(d, o)], cut_points(d, o), strict=False)}
    old, new = cuts(data), cuts(data[:5000] + r.randbytes(64) + data[5000:])
    assert len(old & new) >= 0.9 * len(old)


def test_options(spark):
    assert Options().normalized() == Options(65536, 16384, 262144)
    for bad in (Options(64, 32, 128), Options(64, 128, 256), Options(512, 64, 256), Options(64, 64, 1 << 31)):
        with pytest.raises(ValueError):
            bad.validate()
    cases = [("weight", 1 << 30), ("weight", (1 << 30) - 1), ("weight", 64 << 20), ("weight", (64 << 20) - 1), ("config", 1 << 40), ("other", 0)]
    rows = spark.createDataFrame(cases, "role string, size long").select("role", "size", chunking.options_column(F.col("role"), F.col("size"))).collect()
    assert all(tuple(o) == (lambda x: (x.avg_size, x.min_size, x.max_size))(options_for(role, size)) for role, size, o in rows)
    assert [log2(1), log2(2), log2(255), log2(256)] == [0, 1, 7, 8] and (low_mask(-3), low_mask(0), low_mask(40)) == (1, 1, 2**31 - 1)
    head = lambda rows: chunking.header_options(spark.createDataFrame(rows, "role string, size long")).first()["chunker"]["avg_size"]
    assert head([("weight", 1 << 30), ("other", 1 << 40)]) == 4 << 20 and head([("other", 1 << 40)]) == 65536


@pytest.mark.parametrize(("data", "want"), [(b"", "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"), (b"abc", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"), (bytes(i % 251 for i in range(2049)), "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"), (bytes(i % 251 for i in range(31744)), "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47")])
def test_blake3_vectors(data, want):
    assert hashing.blake3(data).hex() == want


def test_blake3_in_parts_and_batches(spark):
    r = random.Random(4)
    inputs = [r.randbytes(n) for n in (0, 1, 64, 65, 1023, 1024, 1025, 2048, 3072, 5000, 70_000, 5 << 20)]
    alone = [hashing.blake3(x) for x in inputs]
    assert hashing.blake3_many(inputs) == alone
    for x, want in zip(inputs, alone, strict=True):
        h, i = hashing.Blake3(), 0
        while i < len(x):
            n = r.randrange(1, 300_000)
            h.update(x[i : i + n])
            i += n
        assert h.digest() == want
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(inputs[:11])] + [(99, None)], "i long, b binary").select("i", hashing.blake3_column(F.col("b"))).collect()
    assert {i: d and bytes(d) for i, d in rows} == {**dict(enumerate(alone[:11])), 99: None}


def test_table_function(spark):
    chunking.register(spark)
    data = random.Random(5).randbytes(5000)
    spark.createDataFrame([("f", bytearray(data)), ("e", bytearray())], "path string, data binary").createOrReplaceTempView("blobs")
    rows = spark.sql("SELECT path, c.* FROM blobs, LATERAL content_chunks(data, 256, 64, 1024) c ORDER BY path, chunk_idx").collect()
    assert b"".join(bytes(r.payload) for r in rows) == data and [r.offset + r.length for r in rows] == cut_points(data, Options(256, 64, 1024))
