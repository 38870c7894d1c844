"""Exact substring dedup: bytes of strings of a minimum length that also start earlier are removed.

A string of L bytes holds a least hash among its runs of GRAM bytes, wherever it stands; such places are
anchors. Equal strings have equal anchors at equal places, so only anchors whose run occurs again need a
look. The bytes around an anchor that any string of L bytes over it can reach are its context. Equal
contexts of a run are settled by the first of them. Different contexts of one run meet in a block, where
a Burrows-Wheeler transform finds their common strings: an interval of suffixes that share a string is
extended backwards, breadth first, so that common prefixes appear by increasing length, until L. Intervals
are then the classes of equal strings; all but the first of a class are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.near_dup import mix
from treeloom.runtime import cut, join_groups, prepare

LENGTH, GRAM = 100, 32
#: Bytes of a text that are hashed at once, context bytes of a block, contexts of a run that share a block.
SEGMENT, BLOCK_BYTES, TOGETHER = 1 << 20, 1 << 20, 2048
#: Most bytes of a letter, by which intervals are extended; the letter divides the length.
STEP = 25
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
ANCHORS = "doc_id long, pos int, hi int, h long, c long"


def _power(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers:
        n = SEGMENT + 8 * LENGTH
        one = np.ones(n, np.uint64)
        one[1:] = base
        back = np.ones(n, np.uint64)
        back[1:] = pow(base, -1, 2**64)
        _powers[base] = np.cumprod(one, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers[base]


class Hashes:
    """Hashes of any run of bytes, from running sums of a polynomial."""

    def __init__(self, b: np.ndarray, base: int = _BASES[0]):
        forth, self.back = _power(base)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b * forth[: len(b)], dtype=np.uint64, out=self.sums[1:])

    def of(self, lo, hi):
        return (self.sums[hi] - self.sums[lo]) * self.back[lo]

    def all(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n]


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(pos, hi, h, c): anchors, the ends of their contexts, hashes of their runs and of their contexts."""
    w, reach, n = length - gram + 1, length - gram, len(text)
    out = []
    whole = np.frombuffer(text, np.uint8)
    for s in range(0, max(0, n - length + 1), SEGMENT):
        lo, hi = max(0, s - length), min(n, s + SEGMENT + 2 * length)
        hashes = Hashes(whole[lo:hi])
        last = min(n - length, s + SEGMENT - 1)  # the last window's start
        grams = mix(hashes.all(gram)[s - lo : last + w - lo])
        order = (grams >> np.uint64(21) << np.uint64(21)) | np.arange(len(grams), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            order = np.minimum(order[:-size], order[size:])
            size *= 2
        if size < w:
            order = np.minimum(order[: len(order) - (w - size)], order[w - size :])
        at = (order & np.uint64((1 << 21) - 1)).astype(np.int64)
        at = at[np.r_[True, at[1:] != at[:-1]]]
        pos = at + s
        left, right = np.maximum(0, pos - reach), np.minimum(n, pos + length)
        c = mix(hashes.of(left - lo, right - lo) + (pos - left).astype(np.uint64) * np.uint64(_BASES[1]) + mix((right - pos).astype(np.uint64)))
        out.append((pos, right, grams[at], c))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)]
    new = np.r_[True, joined[0][1:] != joined[0][:-1]]
    return tuple(x[new] for x in joined)


def _anchors(docs: DataFrame, text: str, only_runs: bool, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(doc, *anchors(t.encode("utf-8", "surrogatepass"), length)) for doc, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) if t and len(t) * 4 >= length]
            if not rows:
                continue
            h = np.concatenate([r[3] for r in rows]).view(np.int64)
            if only_runs:
                yield pd.DataFrame({"h": h})
            else:
                ids = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows])
                yield pd.DataFrame({"doc_id": ids, "pos": np.concatenate([r[1] for r in rows]), "hi": np.concatenate([r[2] for r in rows]), "h": h, "c": np.concatenate([r[4] for r in rows]).view(np.int64)})

    return docs.select("doc_id", text).filter("doc_id is not null").mapInPandas(run, "h long" if only_runs else ANCHORS)


def transform(text: np.ndarray, step: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sa, before, nxt): the Burrows-Wheeler transform of text over letters of step bytes (their hashes).

    sa: places of text in the order of their suffixes, by one sort of the letters up to length. before: the letter
    at each row's place. nxt: the row of the suffix that starts a letter later, so that a backward step leads
    from nxt[row] by the letter before[row] to row.
    """
    n = len(text)
    letter = np.unique(Hashes(np.concatenate([text, np.zeros(step - 1, np.uint8)])).all(step), return_inverse=True)[1].astype(np.int64)
    columns = np.zeros((length // step, n + length), np.int64)
    for i in range(length // step):
        columns[i, : n - i * step] = letter[i * step :] + 1
    # Some letters to a number: blocks have fewer than 2 ** 21 bytes.
    wide = max(1, 62 // int(n + 2).bit_length())
    keys = []
    for i in range(0, len(columns), wide):
        key = np.zeros(n, np.int64)
        for c in columns[i : i + wide]:
            key = key * (n + 2) + c[:n]
        keys.append(key)
    sa = np.lexsort(keys[::-1])
    row = np.empty(n, np.int64)
    row[sa] = np.arange(n)
    return sa, letter[sa], row[np.minimum(sa + step, n - 1)]


def expand(before: np.ndarray, nxt: np.ndarray, letters: int) -> np.ndarray:
    """For each row the first row of the interval of suffixes that share so many letters.

    Breadth first: an interval of one letter more is what a backward step, by one letter, makes of an
    interval, so an edge between rows appears at the number of letters that their suffixes share. Expansion ends
    at the threshold. (By rows: those that share the next letter, and whose later suffixes share an interval,
    stay together.)
    """
    rows = np.arange(len(before))
    edge = np.r_[True, before[1:] != before[:-1]]
    interval = np.maximum.accumulate(np.where(edge, rows, 0))
    for _ in range(letters - 1):
        went = interval[nxt]
        edge[1:] |= went[1:] != went[:-1]
        interval = np.maximum.accumulate(np.where(edge, rows, 0))
    return interval


def common_strings(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sa, interval): places of text in the order of their suffixes, and for each the first row of the
    interval of suffixes that share its first length bytes; -1 where fewer remain before ends[place].

    Letters are words of step bytes; step divides length (by default it is the largest divisor up to STEP).
    """
    step = step or max(d for d in range(1, STEP + 1) if length % d == 0)
    if length % step:
        raise ValueError(f"letters of {step} bytes don't divide {length}")
    sa, before, nxt = transform(text, step, length)
    return sa, np.where(ends[sa] - sa >= length, expand(before, nxt, length // step), -1)


def _block(parts: list[tuple], length: int) -> tuple[list, pd.DataFrame | None]:
    """parts: (wide, doc_id, lo, context). (removed intervals (doc_id, lo, hi), first strings of wide runs
    with x and y, their hash)."""
    sizes = np.array([len(p[3]) for p in parts])
    text = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    ends = np.repeat(sizes.cumsum(), sizes)
    docs, doc = np.unique([p[1] for p in parts], return_inverse=True)
    start = np.arange(len(text)) - np.repeat(sizes.cumsum() - sizes, sizes) + np.repeat([p[2] for p in parts], sizes)
    place = np.repeat(doc, sizes).astype(np.int64) << 32 | start
    sa, interval = common_strings(text, ends, length)
    live = interval >= 0
    at, cls, order = sa[live], interval[live], place[sa[live]]
    removed = np.zeros(len(text), bool)
    if len(at):
        edges = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
        least = np.repeat(np.minimum.reduceat(order, edges), np.diff(np.r_[edges, len(cls)]))
        removed[at[order > least]] = True
    gone = np.flatnonzero(removed)
    out, firsts = [], None
    if len(gone):
        cuts = np.flatnonzero((np.diff(gone) > 1) | (ends[gone[1:]] != ends[gone[:-1]])) + 1
        for run in np.split(gone, cuts):
            out.append((int(docs[place[run[0]] >> 32]), int(start[run[0]]), int(start[run[-1]]) + length))
    wide = np.repeat([p[0] for p in parts], sizes)
    keep = np.zeros(len(text), bool)
    keep[at] = True
    keep &= wide & ~removed
    own = np.flatnonzero(keep)
    if len(own):
        x, y = (mix(Hashes(text, b).of(own, own + length)).view(np.int64) for b in _BASES)
        firsts = pd.DataFrame({"x": x, "y": y, "doc_id": docs[place[own] >> 32], "lo": start[own]})
    return out, firsts


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """contexts: h, part, wide, doc_id, lo, context, sorted by h and part within partitions."""

    def run(batches):
        held, size, last = [], 0, None

        def rows(parts):
            out, firsts = _block(parts, length)
            kinds = {"x": "Int64", "y": "Int64", "doc_id": "int64", "lo": "int64", "hi": "Int64"}
            yield pd.DataFrame([(None, None, *x) for x in out], columns=list(kinds)).astype(kinds)
            if firsts is not None:
                yield firsts.assign(hi=None).astype(kinds)

        for b in batches:
            for h, part, wide, doc, lo, context in zip(*(b[c] for c in ("h", "part", "wide", "doc_id", "lo", "context")), strict=True):
                if size >= BLOCK_BYTES // 2 and (h, part) != last:
                    yield from rows(held)
                    held, size = [], 0
                held.append((wide, doc, lo, bytes(context)))
                size += len(context)
                last = (h, part)
        if held:
            yield from rows(held)

    return contexts.mapInPandas(run, "x long, y long, doc_id long, lo long, hi long")


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, lo, hi: byte intervals of docs (UTF-8) whose every byte lies in a string of length bytes that
    starts earlier too. Intervals may overlap. Rows that share a doc_id are taken for one document whose
    equal places do not precede each other. length is from GRAM to LENGTH: runs and blocks are made for that."""
    if not GRAM <= length <= LENGTH:
        raise ValueError(f"length {length} is not from {GRAM} to {LENGTH}")
    prepare(docs.sparkSession)
    reach = length - GRAM
    again = cut(_anchors(docs, text, True, length).groupBy("h").count().filter("count > 1"), "again")
    met = cut(join_groups(_anchors(docs, text, False, length), again, ["h"], "count", ["doc_id", "pos"]), "anchors")
    lo = F.greatest(F.lit(0), F.col("pos") - reach)
    same = cut(met.groupBy("h", "c").agg(F.min(F.struct("doc_id", "pos", "hi")).alias("f"), F.count("*").alias("n")), "contexts")
    earlier = same.filter("n > 1").select("h", "c", "n", F.col("f.doc_id").alias("fd"), F.col("f.pos").alias("fp"))
    later = join_groups(met, earlier, ["h", "c"], "n", ["doc_id", "pos"])
    later = later.filter((F.col("doc_id") > F.col("fd")) | ((F.col("doc_id") == F.col("fd")) & (F.col("pos") > F.col("fp")))).select("doc_id", lo.cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    several = cut(same.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").withColumn("_n", F.col("k")), "several")
    parts = F.ceil(F.col("k") / TOGETHER)
    each = join_groups(same, several, ["h"], "_n", ["c"]).select("h", F.pmod(F.col("c"), parts).alias("part"), (parts > 1).alias("wide"), F.col("f.doc_id").alias("doc_id"), F.greatest(F.lit(0), F.col("f.pos") - reach).alias("lo"), F.col("f.hi").alias("hi"))
    wanted = each.groupBy("doc_id").agg(F.collect_list(F.struct("h", "part", "wide", "lo", "hi")).alias("wanted"))  # bounded by the document's length

    def slices(batches):
        for b in batches:
            rows = []
            for doc, t, want in zip(b["doc_id"], b["t"], b["wanted"], strict=True):
                t = t.encode("utf-8", "surrogatepass")
                rows += [(w["h"], w["part"], w["wide"], doc, w["lo"], t[w["lo"] : w["hi"]]) for w in want]
            yield pd.DataFrame(rows, columns=["h", "part", "wide", "doc_id", "lo", "context"])

    texts = docs.select("doc_id", F.col(text).alias("t")).filter("t is not null").join(wanted, "doc_id")
    contexts = texts.mapInPandas(slices, "h long, part long, wide boolean, doc_id long, lo long, context binary")
    contexts = contexts.repartition(F.col("h"), F.col("part")).sortWithinPartitions("h", "part", "doc_id", "lo")
    found = cut(_compare(contexts, length), "common")
    inside = found.filter("hi is not null").select("doc_id", "lo", "hi")
    firsts = found.filter("hi is null")
    winners = firsts.groupBy("x", "y").agg(F.min(F.struct("doc_id", "lo")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    across = join_groups(firsts, cut(winners, "winners"), ["x", "y"], "n", ["doc_id", "lo"]).filter(F.struct("doc_id", "lo") > F.col("f")).select("doc_id", "lo", (F.col("lo") + length).alias("hi"))
    return later.union(inside).union(across)


def remove_repeats(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for each row of docs.

    Null text is empty; texts shorter than length lose nothing; a null doc_id is neither compared nor
    changed; an empty table gives an empty result; other columns are ignored. Ties: of equal strings the
    one in the smallest doc_id, at the smallest start, stays.
    """
    spans = repeated_spans(docs, text=text, length=length)
    spans = spans.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t")).join(spans, "doc_id", "left")

    def run(batches):
        for b in batches:
            rows = []
            for doc, t, spans in zip(b["doc_id"], b["t"], b["spans"], strict=True):
                t = t.encode("utf-8", "surrogatepass")
                kept, at, gone, n = [], 0, 0, 0
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans) if spans is not None else ():
                    if lo > end:
                        n += 1
                        kept.append(t[at:lo])
                        gone += hi - lo
                        end = hi
                    elif hi > end:
                        gone += hi - end
                        end = hi
                    at = end
                kept = b"".join([*kept, t[at:]])
                rows.append((doc, len(t), gone, n, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return own.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
