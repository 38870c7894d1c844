from pyspark.sql import functions as F

from treeloom.streaming.chunks import first_chunks, running_totals

SCHEMA = "path string, digest long, length long, ts timestamp"


def run(spark, tmp_path, build, mode, name):
    rows = [(f"f{i % 7}", i % 40, 10 + i % 40, i) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, digest long, length long, i int")
    df.select("path", "digest", "length", F.timestamp_seconds(F.col("i") + 1_700_000_000).alias("ts")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_each_digest_once(spark, tmp_path):
    got = run(spark, tmp_path, first_chunks, "append", "once")
    assert sorted(r.digest for r in got) == list(range(40))


def test_each_digest_once_with_bounded_state(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: first_chunks(s, time="ts"), "append", "bounded")
    assert sorted(r.digest for r in got) == list(range(40))


def test_running_totals(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: running_totals(s, time="ts", window="1 minute"), "complete", "totals")
    assert sum(r.chunks for r in got) == 200 and sum(r.bytes for r in got) == sum(10 + i % 40 for i in range(200))
