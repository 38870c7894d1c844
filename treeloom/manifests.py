"""Manifests as tables."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import __version__
from treeloom.functions.chunking import Options, header_options, options_column
from treeloom.functions.hashing import Blake3
from treeloom.functions.paths import display_name
from treeloom.operators import layout
from treeloom.operators.manifest import require_valid
from treeloom.runtime import cut
from treeloom.schemas import CHUNKER_NAME, CHUNKS, FILES, FORMAT, HASH, VERSION
from treeloom.sources import tree


@dataclass(frozen=True)
class Manifest:
    """header and model as dicts; files, chunks and shards as tables of treeloom.schemas."""

    header: dict
    model: dict
    files: DataFrame
    chunks: DataFrame

    @property
    def algorithm(self) -> str:
        return "sha256" if self.header["hash"].startswith("sha256") else "blake3"

    def validate(self) -> Manifest:
        for key, want in (("format", FORMAT), ("version", VERSION)):
            if self.header.get(key) != want:
                raise ValueError(f"invalid manifest: {key} {self.header.get(key)!r}")
        if self.header.get("hash") not in (HASH, "sha256"):
            raise ValueError(f"invalid manifest: hash {self.header.get('hash')!r}")
        require_valid(self.files, self.chunks)
        return self

    def as_dict(self) -> dict:
        """Everything, on the driver: for the file codecs only. Tables stay tables elsewhere."""
        by_path: dict[str, list] = {}
        for c in self.chunks.orderBy("path", "chunk_idx").toLocalIterator():
            by_path.setdefault(c["path"], []).append({"offset": c["offset"], "length": c["length"], "digest": bytes(c["digest"]).hex()})
        files = [f.asDict(recursive=True) for f in self.files.orderBy("path").toLocalIterator()]
        rows = [{**f, "digest": f["digest"] and bytes(f["digest"]).hex(), "chunks": by_path.get(f["path"], [])} for f in files]
        return {**self.header, "model": self.model, "files": rows}


def from_dict(spark: SparkSession, m: dict) -> Manifest:
    raw = lambda d: bytes.fromhex(d) if d else None
    sizes = lambda c: {"algorithm": c.get("algorithm", ""), **{k: int(c.get(k) or 0) for k in ("avg_size", "min_size", "max_size")}}
    files = [(f["path"], f["size"], f["mode"], f["mtime_ns"], f["role"], raw(f["digest"]), sizes(f["chunker"])) for f in m["files"]]
    chunks = [(f["path"], i, c["offset"], c["length"], raw(c["digest"])) for f in m["files"] for i, c in enumerate(f["chunks"])]
    header = {k: m.get(k) for k in ("format", "version", "tool", "created_ns", "hash", "chunker")}
    return Manifest(header, m["model"], spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS))


def model_digest(files: DataFrame) -> bytes:
    """BLAKE3 of a line "path, size, hex digest" for each file, in the order of the paths' bytes."""
    line = F.concat_ws("\0", "path", F.col("size").cast("string"), F.coalesce(F.lower(F.hex("digest")), F.lit("0" * 64)))
    lines = files.select("path", F.concat(line, F.lit("\n")).alias("line")).orderBy("path").select("line")
    digest = Blake3()
    for r in lines.toLocalIterator():
        digest.update(r[0].encode())
    return digest.digest()


def build(spark: SparkSession, root: str, *, pin: Options | None = None, algorithm: str = "blake3", hidden: bool = False, follow: bool = True, exclude: list[str] = (), name: str | None = None, warnings: list[str] | None = None) -> Manifest:
    """The manifest of a tree: walk, classify, hash and sum up. Files whose size changed meanwhile are listed
    with the size that was read, and warned of."""
    scanned = cut(tree.scan(spark, root, hidden=hidden, follow=follow, exclude=exclude), "scan")
    found = cut(layout.with_roles(tree.entries(scanned)), "entries")
    hashed = cut(tree.hash_files(found, root, algorithm=algorithm, pin=pin), "hashed")
    failed = hashed.filter("error is not null").select("path", "error").head()
    if failed:
        raise OSError(f"cannot read {failed['path']}: {failed['error']}")
    whole = hashed.filter("chunk_idx = -1").select("path", F.col("length").alias("_read"), "digest")
    chunker = F.struct(F.lit(CHUNKER_NAME).alias("algorithm"), options_column(F.col("role"), F.col("_size"), pin)["avg_size"].alias("avg_size"), options_column(F.col("role"), F.col("_size"), pin)["min_size"].alias("min_size"), options_column(F.col("role"), F.col("_size"), pin)["max_size"].alias("max_size"))
    both = found.join(whole, "path").withColumn("_size", F.col("size"))
    files = cut(both.select("path", F.col("_read").alias("size"), "mode", "mtime_ns", "role", "digest", chunker.alias("chunker"), (F.col("_read") != F.col("_size")).alias("_changed")), "files")
    if warnings is not None:
        warnings += [f"{r['warning']}: {r['path']}" for r in tree.scan_warnings(scanned).orderBy("path").toLocalIterator()]
        warnings += [f"size changed while reading: {r['path']}" for r in files.filter("_changed").orderBy("path").toLocalIterator()]
    files = files.drop("_changed")
    kind = layout.kinds(files).first()
    sums = layout.totals(files).first()
    shards = [r.asDict() for r in layout.shard_sets(files).drop("complete").orderBy("name").toLocalIterator()]
    preset = header_options(files, pin).first()["chunker"].asDict()
    model = {
        "name": display_name(root) if name is None else name,
        "kind": kind["kind"] if kind else "generic",
        "root": root,
        "files": sums["total_files"],
        "size": sums["total_bytes"],
        "weight_files": sums["weight_files"],
        "weight_bytes": sums["weight_bytes"],
        "shards": shards,
        "digest": model_digest(files).hex(),
    }
    header = {"format": FORMAT, "version": VERSION, "tool": f"treeloom {__version__}", "created_ns": int(time.time()) * 10**9, "hash": HASH if algorithm == "blake3" else "sha256", "chunker": {"algorithm": CHUNKER_NAME, **preset}}
    return Manifest(header, model, files, hashed.filter("chunk_idx >= 0").drop("error"))
