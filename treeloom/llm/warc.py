"""WARC archives: a deterministic sharded writer with revisit records, and a reader.

Rows are range-sorted: the bounds of the ranges are quantiles of page_id by bytes, over rows that a hash of
their page_id picks, so that they depend on the data alone; a partition is a range. Each is sorted and written as
gzip members, one a record. A file is closed when its compressed size reaches the target. Files are written
under temporary names that no other attempt shares; a manifest lists those of the attempts that ended, and
only these get their final names, so a lost executor or a repeated task leaves no half file. What other
attempts left goes when all is committed.
"""

from __future__ import annotations

import gzip
import hashlib
import urllib.parse
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.runtime import cut, drop_path, join_groups, new_path, prepare

#: Compressed bytes after which a file is closed, html bytes of a range, and least payload bytes that a revisit
#: may stand for.
FILE_BYTES, RANGE_BYTES, LEAST_REVISIT = 64 << 20, 64 << 20, 100
#: Compressed bytes that one task reads back, rows (about) whose page_ids settle the bounds of ranges, and ranges
#: at most; rows of a range that is larger than it should be are written by one task, file by file.
TASK_BYTES, SAMPLE_ROWS, RANGES = 256 << 20, 100_000, 20_000
#: The date of every record: files depend on the pages alone.
DATE = "WARC-Date: 1970-01-01T00:00:00Z"
WRITTEN = "range_id long, shard int, temp string, name string, records long, bytes long, sha256 string"
PARSED = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str | None) -> str:
    """url with what a header can't hold percent-encoded; what is encoded already stays."""
    return urllib.parse.quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._", errors="replace")


def _record(head: list[str], body: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def info_bytes(name: str) -> bytes:
    """The record that opens a file."""
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>", DATE, f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response, or its head alone for a revisit. X-Payload-Length tells the
    payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        DATE,
        f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'null' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return _record(head, http if refers_to is not None else http + payload)


def plan_revisits(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, refers_to of the rows whose payload an earlier page_id has. Without payloads."""
    html = F.coalesce(pages["html"], F.lit(""))
    p = pages.filter(F.octet_length(html) >= LEAST_REVISIT).select("page_id", F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    same = p.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    return join_groups(p, cut(same, "same"), ["payload_digest"], "n", ["page_id"]).filter(F.col("page_id") > F.col("refers_to")).select("page_id", "payload_digest", "refers_to").distinct()


def range_bounds(pages: DataFrame, ranges: int, n: int) -> np.ndarray:
    """ranges - 1 page_ids at most, ascending, that divide the rows into ranges of about equal bytes.

    They are quantiles over the rows whose page_id's hash falls into one of a power of two parts, about
    SAMPLE_ROWS rows that come to the driver as pairs of numbers, one for each page_id."""
    if ranges < 2:
        return np.empty(0, np.int64)
    parts = 1 << max(0, (n // SAMPLE_ROWS).bit_length() - 1) if n > 2 * SAMPLE_ROWS else 1
    some = pages.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(parts)) == 0))
    found = some.groupBy("page_id").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 512).alias("w")).orderBy("page_id").toPandas()
    if found.empty:
        return np.empty(0, np.int64)
    at = found["w"].cumsum().to_numpy()
    return np.unique(found["page_id"].to_numpy()[np.searchsorted(at, at[-1] * np.arange(1, ranges) / ranges)])


def write_warc(pages: DataFrame, path: str, *, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) below path; returns the manifest, which is also kept there.

    Null html is an empty payload, a null url an empty one. Repeated page_ids are written each, by one task;
    of rows that tie for the least page_id of a payload, all are responses. Rows with a null page_id come
    first; they are revisits of none, and none revisits them. An empty table writes an empty manifest. Other
    columns are ignored, and payloads may be as long as a row can be.
    """
    spark = prepare(pages.sparkSession)
    n, total = pages.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    # Some 64 ranges where there is less than so many times range_bytes.
    ranges = min(RANGES, max(1, -(-(total or 0) // range_bytes), min(64, n // 256)))
    bounds = range_bounds(pages, ranges, n)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.fillna(-(2**63)).to_numpy(np.int64), side="right")
        return pd.Series(at.astype(np.int32))

    html = F.coalesce(pages["html"], F.lit(""))
    p = pages.select(pages["page_id"], pages["url"], html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind"))
    # The plan travels as rows of its own, each before the pages that it is of: payloads move once.
    revisits = plan_revisits(pages).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "payload_digest", "refers_to", F.lit(0).alias("kind"))
    keyed = p.unionByName(revisits).withColumn("range_id", range_of(F.coalesce("page_id", F.lit(-(2**63)))))
    rows = keyed.repartitionById(len(bounds) + 1, "range_id").sortWithinPartitions("range_id", "page_id", "payload_digest", "kind", "url")

    def run(batches):
        files, root, out, planned = None, None, None, (None, None, None)

        def close():
            out["file"].close()
            return (out["range"], out["shard"], out["temp"], f"part-{out['range']:012d}-{out['shard']:05d}.warc.gz", out["records"], out["bytes"], out["sha"].hexdigest())

        for b in batches:
            done = []
            for page, url, html, digest, refers, kind, rng in zip(*(b[c] for c in ("page_id", "url", "html", "payload_digest", "refers_to", "kind", "range_id")), strict=True):
                rng, page = int(rng), (None if pd.isna(page) else int(page))
                if kind == 0:
                    planned = page, digest, int(refers)
                    continue
                refers = planned[2] if planned[:2] == (page, digest) else None
                if out is None or out["range"] != rng or out["bytes"] >= file_bytes:
                    shard = out["shard"] + 1 if out and out["range"] == rng else 0
                    if out:
                        done.append(close())
                    if root is None:
                        files, root = _fs(path)
                        files.create_dir(f"{root}/_temporary", recursive=True)
                    temp = f"_temporary/{rng}-{shard}-{uuid.uuid4().hex}"
                    opening = gzip.compress(info_bytes(f"part-{rng:012d}-{shard:05d}.warc.gz"), 6, mtime=0)
                    out = {"range": rng, "shard": shard, "temp": temp, "file": files.open_output_stream(f"{root}/{temp}", compression=None), "records": 0, "bytes": len(opening), "sha": hashlib.sha256(opening)}
                    out["file"].write(opening)
                member = gzip.compress(record_bytes(page, url, html.encode(), digest, refers), 6, mtime=0)
                out["file"].write(member)
                out["sha"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in WRITTEN.split(", ")])
        if out:
            yield pd.DataFrame([close()], columns=[c.split()[0] for c in WRITTEN.split(", ")])

    rows.mapInPandas(run, WRITTEN).write.parquet(f"{path}/_written")

    def commit(batches):
        files, root = _fs(path)
        for b in batches:
            for temp, name in zip(b["temp"], b["name"], strict=True):
                if files.get_file_info(f"{root}/{name}").type.name == "NotFound":  # else a former attempt came so far
                    files.move(f"{root}/{temp}", f"{root}/{name}")
            yield b.drop(columns="temp")

    written = spark.read.schema(WRITTEN).parquet(f"{path}/_written")
    written.mapInPandas(commit, WRITTEN.replace("temp string, ", "")).write.parquet(f"{path}/manifest")
    drop_path(spark, f"{path}/_temporary")
    drop_path(spark, f"{path}/_written")
    return spark.read.schema(WRITTEN.replace("temp string, ", "")).parquet(f"{path}/manifest")


def members(read):
    """Each gzip member's bytes, of a stream of which read(n) gives the next n bytes at most."""
    z, parts, buf = zlib.decompressobj(31), [], b""
    while True:
        buf = buf or read(1 << 20)
        if not buf:
            if parts:
                raise EOFError("the last gzip member is cut short")
            return
        parts.append(z.decompress(buf))
        buf = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []


def parse(record: bytes) -> tuple | None:
    """A row of PARSED, none for records that are no pages; digests must agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    body = rest[: int(h["Content-Length"])]
    kind = h["WARC-Type"]
    if f"sha256:{hashlib.sha256(body).hexdigest()}" != h["WARC-Block-Digest"] or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    if kind not in ("response", "revisit"):
        return None
    payload = body.partition(b"\r\n\r\n")[2]
    size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].split(":")[1]
    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"the payload of {h['WARC-Record-ID']} is not the one that it tells of")
    page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page-ID")
    return None if page == "null" else int(page), h.get("WARC-Target-URI", ""), kind, refers and int(refers), size, digest, payload


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives that path's manifest lists, in PARSED's columns."""
    names = spark.read.schema(WRITTEN.replace("temp string, ", "")).parquet(f"{path}/manifest").select("name", "bytes")
    n, total = names.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, -(-total // TASK_BYTES) + spark.sparkContext.defaultParallelism))

    def run(batches):
        files, root = _fs(path)
        for b in batches:
            for name in b["name"]:
                rows, size = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for m in members(f.read):
                        if (row := parse(m)) is not None:
                            rows.append(row)
                        size += len(m)
                        if size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows)

    return names.repartition(tasks, "name").mapInPandas(run, PARSED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to the shared folder and reads the archives back, without payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
