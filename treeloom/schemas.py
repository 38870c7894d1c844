"""Row types of the tables that operators exchange."""

from __future__ import annotations

ENTRIES = "path string, size long, mode int, mtime_ns long"
CHUNKER = "struct<algorithm: string, avg_size: long, min_size: long, max_size: long>"
FILES = f"path string, size long, mode int, mtime_ns long, role string, digest binary, chunker {CHUNKER}"
CHUNKS = "path string, chunk_idx int, offset long, length long, digest binary"
SHARDS = "name string, parts array<string>, total int, size long"
WARNINGS = "path string, warning string"
PLAN_FILES = "path string, action string, size long, role string, need_chunks long, need_bytes long, reuse_bytes long"
LOCATIONS = "digest binary, src_path string, offset long, length long, origin string"

#: Fixed names of a manifest. Another dialect's may be given to the codecs.
FORMAT, VERSION, MAGIC = "treeloom-manifest", 1, b"TLM1"
HASH = "blake3-256"
CHUNKER_NAME = "gear-lowbits-seeded"
STATE_DIR, MANIFEST_NAME, STAGE_DIR = ".treeloom", "manifest.json", "stage"
