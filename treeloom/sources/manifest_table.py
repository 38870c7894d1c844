"""Manifest files as tables, read by executors."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeloom.runtime import prepare
from treeloom.schemas import CHUNKER
from treeloom.sources.codec import decode

ROW = f"manifest string, path string, size long, mode int, mtime_ns long, role string, file_digest string, chunker {CHUNKER}, chunk_idx int, offset long, length long, digest string"
#: Schema of a JSON manifest, for spark.read.schema(JSON).option("multiLine", True).json(path).
JSON = f"""format string, version int, tool string, created_at string, hash string, chunker {CHUNKER},
model struct<name: string, kind: string, root: string, files: long, size: long, weight_files: long, weight_bytes: long,
  shards: array<struct<name: string, parts: array<string>, total: int, size: long>>, digest: string, extra: map<string, string>>,
files array<struct<path: string, size: long, mode: long, mod_time: string, role: string, digest: string, chunker: {CHUNKER},
  chunks: array<struct<offset: long, length: long, digest: string>>>>"""


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ManifestSource(DataSource):
    """spark.read.format("manifest").load(glob): a row for each chunk, and one with a null chunk_idx for each
    file without chunks, of manifests in either encoding; a partition a manifest. Its digest is checked."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return _ManifestReader(self.options["path"].removeprefix("file://"))


class _ManifestReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(os.path.abspath(p)) for p in found]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            m = decode(f.read())
        for f in m["files"]:
            c = f["chunker"]
            own = (partition.path, f["path"], f["size"], f["mode"], f["mtime_ns"], f["role"], f["digest"], (c.get("algorithm", ""), c.get("avg_size", 0), c.get("min_size", 0), c.get("max_size", 0)))
            for i, x in enumerate(f["chunks"]):
                yield (*own, i, x["offset"], x["length"], x["digest"])
            if not f["chunks"]:
                yield (*own, None, None, None, None)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    spark.dataSource.register(ManifestSource)
    return spark.read.format("manifest").load(path)


def read_json_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of JSON manifests by Spark's own reader, in ROW's columns but for mtime_ns and chunker."""
    m = spark.read.schema(JSON).option("multiLine", True).json(path).select(F.input_file_name().alias("manifest"), F.explode("files").alias("f"))
    rows = m.select("manifest", "f.path", "f.size", F.col("f.mode").cast("int").alias("mode"), "f.role", F.col("f.digest").alias("file_digest"), F.posexplode_outer("f.chunks").alias("chunk_idx", "c"))
    return rows.select("manifest", "path", "size", "mode", "role", "file_digest", "chunk_idx", "c.offset", "c.length", "c.digest")
