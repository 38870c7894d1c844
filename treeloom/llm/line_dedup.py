"""Line dedup by a fixed-depth template tree.

A line goes down the tree by its number of tokens and then by its first two tokens. Tokens with a digit are
variable fields, in lines of four tokens or more. In the leaf a line belongs to its literal template, which
fixes all other tokens, and to looser ones, which generalise some places whatever they hold: a window of
neighbouring places (three windows, which overlap, together cover the line), or every other place. Two lines
of a leaf so share a template if they agree outside a window, or at every other place. Lines of fewer than
ten tokens have narrower windows, of a third of the line, and no template of every other place; lines of
fewer than four have their literal template alone; blank lines have none and stay.

Templates depend on the line alone, not on the order of lines or on how many there are, so that a leaf is
never gathered: templates are counted by an aggregation, which is combined before rows move.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.near_dup import mix
from treeloom.runtime import cut, join_groups, prepare

#: Leading tokens of the tree, leading tokens that templates of every other place fix, least tokens of a
#: line with variable fields, and of a longer one, documents that make a template recur.
DEPTH, ALTERNATE, LEAST, LONG, DOCUMENTS = 2, 3, 4, 10, 2
#: Windows of a line.
WINDOWS = 3
#: Token hashes that a task remembers.
TOKENS = 500_000
_DIGIT = re.compile(rb"[0-9]")
_PLACE, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """token -> hash; the last bit tells that it has a digit."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= TOKENS:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token) & ~1 | bool(_DIGIT.search(token))
        return h


def templates(lines: list[bytes], hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line numbers, template ids, whether the template is a loose one of a line of fewer than LONG tokens)."""
    tokens = [x.split() for x in lines]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(tokens)), np.uint64, int(sizes.sum()))
    ends = sizes.cumsum()
    starts = ends - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    digit = (flat & np.uint64(1)).astype(bool)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, x.dtype), x.cumsum(dtype=x.dtype)])

    digits = summed(digit.astype(np.int64))
    # Short lines, and those of mostly fields, keep all their tokens.
    masked = (sizes >= LEAST) & (2 * (sizes - (digits[ends] - digits[starts])) >= sizes)
    field = digit & np.repeat(masked, sizes)
    part = mix(np.where(field, np.uint64(1), flat & ~np.uint64(1)) + place.astype(np.uint64) * _PLACE)
    fixed = (~field).astype(np.int64)
    rows, ids, loose = [], [], []

    def add(which, sums, kind, short) -> None:
        kind = np.broadcast_to(np.asarray(kind, np.uint64), len(which))
        rows.append(which)
        ids.append(mix(mix(sums + sizes[which].astype(np.uint64) * _PLACE) + kind * _SEED))
        loose.append(np.broadcast_to(short, len(which)))

    h, f = summed(part), summed(fixed)
    some = np.flatnonzero(sizes > 0)
    add(some, h[ends[some]] - h[starts[some]], 0, False)
    some = np.flatnonzero(sizes >= LEAST)
    n, rest = sizes[some], sizes[some] - DEPTH
    width = np.where(n >= LONG, rest // 2, np.maximum(1, n // 3))
    former = np.full(len(some), -1)
    for k in range(WINDOWS):
        start = DEPTH + k * (rest - width) // (WINDOWS - 1)  # a window is known by its start
        lo, hi = starts[some] + start, starts[some] + start + width
        left = f[ends[some]] - f[starts[some]] - (f[hi] - f[lo])
        able = (start > former) & np.where(n >= LONG, 2 * left >= n, 3 * left >= 2 * n)
        sums = h[ends[some]] - h[starts[some]] - (h[hi] - h[lo])
        add(some[able], sums[able], start[able] + 2, (n < LONG)[able])
        former = start
    some = np.flatnonzero(sizes >= LONG)
    for parity in (0, 1):
        out = (place >= ALTERNATE) & (place % 2 == parity)
        h, f = summed(np.where(out, np.uint64(0), part)), summed(np.where(out, 0, fixed))
        which = some[2 * (f[ends[some]] - f[starts[some]]) >= sizes[some]]
        add(which, h[ends[which]] - h[starts[which]], 1 + parity, False)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(loose)


def _lines(docs: DataFrame) -> DataFrame:
    """docs: _d, _h, _t. d, h, line, template, new (whether it is the document's first line of the template),
    short (whether it takes one document more)."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in b["_t"]]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            doc = np.repeat(np.arange(len(texts)), sizes)
            number = np.arange(len(doc)) - np.repeat(sizes.cumsum() - sizes, sizes)
            at, ids, short = templates(list(chain.from_iterable(texts)), hashes)
            order = np.lexsort((number[at], ids, doc[at]))
            at, ids, short = at[order], ids[order], short[order]
            of = doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
            yield pd.DataFrame({"d": b["_d"].to_numpy()[of], "h": b["_h"].to_numpy()[of], "line": number[at].astype(np.int32), "template": ids.view(np.int64), "new": new, "short": short})

    return docs.mapInPandas(run, "d long, h long, line int, template long, new boolean, short boolean")


def drop_recurring_lines(docs: DataFrame, *, text: str = "text", documents: int = DOCUMENTS) -> DataFrame:
    """docs with the text less its recurring lines, and n_lines and n_dropped beside it.

    A template recurs if lines of it stand in different documents, at least so many (one more for a loose
    template of a line of fewer than ten tokens: two may be alike by chance). In the document with the least
    doc_id its first line stays; all its other lines go. Lines are what newlines divide; the rest keep their
    order. Whole texts are taken, however long.

    Null text stays null with no lines. Rows that repeat a doc_id are parts of one document, of which no part
    precedes the other: each may keep a first line, and each adds to the number; a row loses what its own
    text calls for. Rows with a null doc_id are such parts of one document, which precedes all. An empty
    table gives an empty result. Other columns may have any name; n_lines and n_dropped are replaced.
    """
    if documents < 2:
        raise ValueError("a line recurs in two documents at least")
    prepare(docs.sparkSession)
    t = docs[text]
    key = [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64(t).alias("_h")]
    lines = cut(_lines(docs.select(*key, t.alias("_t")).filter("length(_t) > 0")), "lines")
    found = lines.groupBy("template").agg(F.min("d").alias("least"), F.max("d").alias("last"), F.count_if("new").alias("n"), F.max("short").alias("short"), F.count("*").alias("_n"))
    found = found.filter((F.col("least") < F.col("last")) & (F.col("n") >= documents + F.col("short").cast("int")))
    found = cut(found.select("template", "least", "_n"), "recurring")
    gone = join_groups(lines.select("d", "h", "line", "template", "new"), found, ["template"], "_n", ["d", "h", "line"]).filter((F.col("d") > F.col("least")) | ~F.col("new"))
    gone = gone.groupBy("d", "h").agg(F.collect_set("line").alias("gone")).select(F.col("d").alias("_d"), F.col("h").alias("_h"), "gone")
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row")
    out = docs.select(*key, row).join(gone.hint("merge"), ["_d", "_h"], "left")
    own = {c: F.col(f"_row.c{i}") for i, c in enumerate(docs.columns)}
    whole = own[text]
    n = F.when(whole.isNull(), 0).otherwise(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rest = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.filter(F.split(whole, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    kept = [(rest if c == text else v).alias(c) for c, v in own.items() if c not in ("n_lines", "n_dropped")]
    return out.select(*kept, n.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
