"""The delta plan: what has to be sent so that a destination holds the wanted files.

wanted files: path, size, mtime_ns, role, digest; wanted chunks: path, chunk_idx, length, digest.
destination files: path, size, mtime_ns, digest (null if they were not hashed); destination chunks: path,
chunk_idx, offset, length, digest; staged chunks: the like, of interrupted files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.layout import role_rank


@dataclass(frozen=True)
class Options:
    """dedupe: files that the manifest doesn't name are sources too. fast: equal size and mtime stand for
    equal content. atomic: "file" replaces each file as it is done, so that its old content serves only
    itself; "model" replaces all at the end. resume: staged chunks are sources. delete: others go."""

    dedupe: bool = True
    fast: bool = False
    atomic: str = "file"
    resume: bool = True
    delete: bool = False


def candidates(dest: DataFrame, wanted: DataFrame, options: Options) -> DataFrame:
    """The destination entries that have to be hashed: a test on metadata alone, before any file is read."""
    w = wanted.select("path", F.col("size").alias("w_size"), F.col("mtime_ns").alias("w_mtime"))
    both = dest.join(w, "path", "left" if options.dedupe else "inner")
    if not options.fast:
        return both.select(dest.columns)
    trusted = F.coalesce((F.col("size") == F.col("w_size")) & (F.col("mtime_ns") == F.col("w_mtime")), F.lit(False))
    return both.filter(~trusted).select(dest.columns)


def _state(wanted: DataFrame, dest: DataFrame, options: Options) -> DataFrame:
    """wanted with action, and whether the destination's file was trusted without a look."""
    d = dest.select("path", F.col("size").alias("d_size"), F.col("mtime_ns").alias("d_mtime"), F.col("digest").alias("d_digest"), F.lit(True).alias("there"))
    trusted = F.lit(False)
    if options.fast:
        trusted = F.col("there").isNotNull() & (F.col("size") == F.col("d_size")) & (F.col("mtime_ns") == F.col("d_mtime"))
    same = (F.col("digest") == F.col("d_digest")) & (F.col("size") == F.col("d_size"))
    out = wanted.join(d, "path", "left").withColumn("trusted", F.coalesce(trusted, F.lit(False)))
    action = F.when(F.col("there").isNull(), "copy").when(F.col("trusted") | F.coalesce(same, F.lit(False)), "skip").otherwise("update")
    return out.withColumn("action", action)


def sources(state: DataFrame, wanted_chunks: DataFrame, dest: DataFrame, dest_chunks: DataFrame, staged: DataFrame | None, options: Options) -> DataFrame:
    """digest, src_path, offset, length, origin of every chunk at the destination that may serve.

    origin: "own" serves only the file of that path; "staged" and "global" serve all."""
    known = state.select("path", "action", "trusted")
    at = dest_chunks.join(known, "path", "left" if options.dedupe else "inner")
    origin: Column = F.when((F.col("action") == "update") & F.lit(options.atomic == "file"), "own").otherwise("global")
    out = at.filter(~F.coalesce("trusted", F.lit(False))).select("digest", F.col("path").alias("src_path"), "offset", "length", origin.alias("origin"))
    if options.fast:  # a trusted file is described by the manifest's own chunks
        own = wanted_chunks.join(known.filter("trusted"), "path", "left_semi")
        out = out.union(own.select("digest", F.col("path").alias("src_path"), "offset", "length", F.lit("global")))
    if staged is not None and options.resume:
        out = out.union(staged.select("digest", F.col("file" if "file" in staged.columns else "path").alias("src_path"), "offset", "length", F.lit("staged")))
    return out


def staged_chunks(staged: DataFrame, wanted_chunks: DataFrame) -> DataFrame:
    """Of the chunks found in staged files (path: the file that each is of; file: its own name) those that the
    manifest has at that very place."""
    return staged.join(wanted_chunks.select("path", "offset", "length", "digest"), ["path", "offset", "length", "digest"])


@dataclass(frozen=True)
class Plan:
    """files: path, action, size, role, need_chunks, need_bytes, reuse_bytes. chunks: those of files that are
    not skipped, with need. need: path, digest to be sent. deletes: paths. locations: see sources()."""

    files: DataFrame
    chunks: DataFrame
    deletes: DataFrame
    locations: DataFrame

    @property
    def need(self) -> DataFrame:
        return self.chunks.filter("need").select("path", "chunk_idx", "digest", "length")

    @property
    def work(self) -> DataFrame:
        return self.files.filter("action <> 'skip'")

    @property
    def totals(self) -> DataFrame:
        """One row. need + reuse + skip bytes make the total bytes."""
        s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        out = self.files.agg(
            F.count("*").alias("total_files"),
            *[F.count_if(F.col("action") == a).alias(f"{a}_files") for a in ("copy", "update", "skip")],
            s("size").alias("total_bytes"),
            s("need_bytes").alias("need_bytes"),
            s("reuse_bytes").alias("reuse_bytes"),
            s(F.when(F.col("action") == "skip", F.col("size"))).alias("skip_bytes"),
        )
        return out.withColumn("savings", F.when(F.col("total_bytes") == 0, 1.0).otherwise(1 - F.col("need_bytes") / F.col("total_bytes")))


def plan(wanted: DataFrame, wanted_chunks: DataFrame, dest: DataFrame, dest_chunks: DataFrame, staged: DataFrame | None = None, options: Options = Options()) -> Plan:
    """The plan. A chunk is needed if no chunk of its digest comes before it, in transfer order over the files
    that are not skipped, and the destination has the digest nowhere that serves its file.

    "Before" is a minimum over each digest, which is combined ahead of the shuffle, and availability is a
    flag a digest: a digest in a third of all chunks costs no task more than others.
    """
    state = _state(wanted, dest, options)
    found = sources(state, wanted_chunks, dest, dest_chunks, staged, options)
    work = state.filter("action <> 'skip'").select("path", role_rank(F.coalesce("role", F.lit(""))).alias("_rank"))
    rows = wanted_chunks.select("path", "chunk_idx", "length", "digest", *[c for c in ("offset",) if c in wanted_chunks.columns]).join(work, "path")
    place = F.struct("_rank", "path", "chunk_idx")
    everywhere = found.filter("origin <> 'own'").select("digest").distinct().withColumn("_there", F.lit(True))
    first = rows.groupBy("digest").agg(F.min(place).alias("_first")).join(everywhere, "digest", "left").filter("_there is null").select("digest", "_first")
    own = found.filter("origin = 'own'").select(F.col("src_path").alias("path"), "digest").distinct().withColumn("_own", F.lit(True))
    marked = rows.join(first, "digest", "left").join(own, ["path", "digest"], "left")
    # The first file of a digest may have it itself; the file still makes it available to those after it.
    need = F.coalesce(place == F.col("_first"), F.lit(False)) & F.col("_own").isNull()
    chunks = marked.select(*rows.drop("_rank").columns, need.alias("need"))
    per = chunks.groupBy("path").agg(F.count_if("need").alias("nc"), F.sum(F.when(F.col("need"), F.col("length")).otherwise(0)).alias("nb"), F.sum(F.when(F.col("need"), 0).otherwise(F.col("length"))).alias("rb"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n)
    files = state.join(per, "path", "left").select("path", "action", "size", "role", zero("nc", "need_chunks"), zero("nb", "need_bytes"), zero("rb", "reuse_bytes"))
    gone = dest.select("path").join(wanted.select("path"), "path", "left_anti")
    return Plan(files, chunks, gone if options.delete else gone.limit(0), found)


def best_locations(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """For each chunk (path, chunk_idx, digest) that some location serves: the best one. The file's own old
    content comes first, then staged, then global ones; ties go to the least path and offset."""
    rank = F.when(F.col("origin") == "own", 0).when(F.col("origin") == "staged", 1).otherwise(2)
    pick = lambda df, *keys: df.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), "src_path", "offset", "length", "origin")).alias("at"))
    shared = pick(locations.filter("origin <> 'own'"), "digest").withColumnRenamed("at", "shared")
    own = pick(locations.filter("origin = 'own'").withColumn("path", F.col("src_path")), "path", "digest").withColumnRenamed("at", "own")
    both = chunks.join(shared, "digest", "left").join(own, ["path", "digest"], "left").withColumn("at", F.coalesce("own", "shared")).filter("at is not null")
    return both.select("path", "chunk_idx", "digest", F.col("at.src_path").alias("src_path"), F.col("at.offset").alias("src_offset"), F.col("at.origin").alias("origin"))


def received(chunks: DataFrame) -> DataFrame:
    """path, received_bytes, reused_bytes: each place where a sent digest of the same file belongs counts as
    received, so a digest that repeats in a file counts more than once."""
    sent = chunks.filter("need").select("path", "digest").distinct().withColumn("_sent", F.lit(True))
    both = chunks.join(sent, ["path", "digest"], "left")
    got = F.col("_sent").isNotNull()
    return both.groupBy("path").agg(F.sum(F.when(got, F.col("length")).otherwise(0)).alias("received_bytes"), F.sum(F.when(got, 0).otherwise(F.col("length"))).alias("reused_bytes"))


def apply_summary(p: Plan) -> DataFrame:
    """One row: what applying the plan receives, reuses, writes, skips and deletes."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    got = received(p.chunks).agg(s("received_bytes").alias("received_bytes"), s("reused_bytes").alias("reused_bytes"))
    files = p.files.agg(F.count_if(F.col("action") != "skip").alias("written_files"), F.count_if(F.col("action") == "skip").alias("skipped_files"), s("size").alias("total_bytes"))
    gone = p.deletes.agg(F.count("*").alias("deleted_files"))
    out = got.join(files).join(gone)  # one row each
    return out.withColumn("savings", F.when(F.col("total_bytes") == 0, 1.0).otherwise(1 - F.col("received_bytes") / F.col("total_bytes")))
