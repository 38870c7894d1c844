"""Roles of files, kinds of trees, shard sets and transfer order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.paths import basename, dirname, extension

#: Fixed values.
WEIGHT_EXTENSIONS = [".safetensors", ".gguf", ".bin", ".pt", ".pth", ".ckpt", ".onnx", ".msgpack", ".h5", ".npz", ".model"]
CONFIG_NAMES = ["config.json", "generation_config.json", "preprocessor_config.json", "adapter_config.json", "quantize_config.json", "params.json"]
TOKENIZER_NAMES = ["vocab.json", "merges.txt", "special_tokens_map.json", "spiece.model", "vocab.txt"]
METADATA_EXTENSIONS = [".md", ".txt", ".json", ".yaml", ".yml"]
METADATA_NAMES = ["license", "modelfile"]
ROLE_RANK = {"config": 0, "index": 1, "tokenizer": 2, "metadata": 3, "other": 4, "weight": 5}
SHARD = r"\A(.*?)-(\d{2,6})-of-(\d{2,6})(\.[A-Za-z0-9]+)\z"
BLOB = r"\Asha256[-:][0-9a-f]{64}\z"
MIB = 1 << 20


def role_by_name(path: Column, size: Column) -> Column:
    """What a file's name, and the size of a ``.model`` file, say of it."""
    name = F.lower(basename(path))
    ext = F.lower(extension(path))
    return (
        F.when(name.endswith(".index.json"), "index")
        .when(name.isin(CONFIG_NAMES), "config")
        .when(name.startswith("tokenizer") | name.isin(TOKENIZER_NAMES), "tokenizer")
        .when(ext.isin(METADATA_EXTENSIONS) | name.isin(METADATA_NAMES), "metadata")
        .when((ext == ".model") & (size < 64 * MIB), "tokenizer")
        .when(ext.isin(WEIGHT_EXTENSIONS), "weight")
        .otherwise("other")
    )


def is_blob(path: Column) -> Column:
    return F.lower(basename(path)).rlike(BLOB) & path.startswith("blobs/")


def kinds(files: DataFrame, *keys: str) -> DataFrame:
    """keys and kind: one row for each tree of files (path; trees are told apart by keys)."""
    name, ext, path = F.lower(basename(F.col("path"))), F.lower(extension(F.col("path"))), F.col("path")
    plain = (name != "config.json") & ~name.endswith(".index.json")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = files.groupBy(*keys).agg(
        some(is_blob(path)).alias("blob"),
        some(path.startswith("manifests/")).alias("listed"),
        some(plain & (ext == ".safetensors")).alias("safe"),
        some(plain & (ext == ".gguf")).alias("gguf"),
        some(name.endswith(".index.json")).alias("index"),
    )
    kind = F.when(F.col("blob") & F.col("listed"), "ollama").when(F.col("gguf") & ~F.col("safe"), "gguf").when(F.col("safe") | F.col("index"), "huggingface").otherwise("generic")
    return seen.select(*keys, kind.alias("kind"))


def with_roles(files: DataFrame, *keys: str) -> DataFrame:
    """files with role: the name's, but for the blobs of an ollama tree their size decides."""
    named = role_by_name(F.col("path"), F.col("size"))
    kind = kinds(files, *keys).withColumnRenamed("kind", "_kind")
    # Without keys there is one tree, so one row; with keys the planner decides by size.
    both = files.join(kind, list(keys)) if keys else files.join(F.broadcast(kind))
    blob = (F.col("_kind") == "ollama") & is_blob(F.col("path"))
    return both.withColumn("role", F.when(blob & (F.col("size") >= MIB), "weight").when(blob, "metadata").otherwise(named)).drop("_kind")


def shard_sets(files: DataFrame, *keys: str) -> DataFrame:
    """keys, name, parts, total, size, complete: families of weight files "-00001-of-00003".

    total is what the first part by path declares.
    """
    base = basename(F.col("path"))
    part = lambda i: F.regexp_extract(base, SHARD, i)
    total = part(3).cast("int")
    parts = files.filter((F.col("role") == "weight") & base.rlike(SHARD)).filter(total > 1)
    name = F.concat(dirname(F.col("path")), part(1), part(4))
    sets = parts.select(*keys, "path", "size", name.alias("name"), total.alias("total")).groupBy(*keys, "name")
    out = sets.agg(F.sort_array(F.collect_list("path")).alias("parts"), F.min_by("total", "path").alias("total"), F.sum("size").alias("size"))
    return out.withColumn("complete", F.size("parts") == F.col("total"))


def role_rank(role: Column) -> Column:
    rank = F.lit(0)
    for name, k in ROLE_RANK.items():
        rank = F.when(role == name, k).otherwise(rank)
    return rank


def transfer_order(files: DataFrame) -> list[Column]:
    """Sort keys: small descriptive files first, weights last, then by path."""
    return [role_rank(F.coalesce(files["role"], F.lit(""))), files["path"]]


def totals(files: DataFrame, *keys: str) -> DataFrame:
    weight = F.col("role") == "weight"
    return files.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if(weight).alias("weight_files"),
        F.coalesce(F.sum(F.when(weight, F.col("size"))), F.lit(0)).alias("weight_bytes"),
    )


def describe(kind: str, name: str, total_files: int, weight_files: int, shards: int) -> str:
    called = f' "{name}"' if name else ""
    sets = f"; shard sets: {shards}" if shards else ""
    return f"{kind}{called}: {weight_files} of {total_files} files hold weights{sets}"
