"""Best-fit packing of tokenized documents after a Martello-Toth reduction.

Pieces of one length are interchangeable, so the instance is a histogram of lengths: at most ``capacity``
numbers, whatever the input. The driver reduces and packs the histogram; tasks then give each piece its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.pieces import Cache, chunks
from treeloom.runtime import cut, prepare

_caches: dict[str, Cache] = {}
#: Pieces that are ranked together: a length with more is ranked in parts.
RANK_ROWS = 50_000

Pattern = tuple[int, list[tuple[int, int]]]


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth dominance: (fixed patterns, what remains).

    For each length, largest first: nothing else fits beside it, then it stands alone; one other item at
    most fits, or the largest that fits fills the sequence, or it outweighs every fitting pair when at most
    two fit: then it goes with that item. Removing items never breaks these conditions, so a rule is
    applied to all equal items at once.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    for j in sorted(left, reverse=True):
        while left.get(j, 0) > 0:
            left[j] -= 1  # this item; the others are its possible partners
            sizes = sorted(s for s, n in left.items() if n > 0)
            room, small = capacity - j, []
            for s in sizes:
                small += [s] * min(left[s], 3 - len(small))
                if len(small) == 3:
                    break
            left[j] += 1
            if not small or small[0] > room:
                fixed.append((left[j], [(j, 1)]))
                left[j] = 0
                continue
            partner = sizes[bisect_right(sizes, room) - 1]
            at_most_one = len(small) < 2 or small[0] + small[1] > room
            at_most_two = len(small) < 3 or sum(small) > room
            if not (partner == room or at_most_one or (at_most_two and partner >= _best_pair(sizes, left, j, room))):
                break
            n = left[j] // 2 if partner == j else min(left[j], left[partner])
            fixed.append((n, [(j, 2)] if partner == j else [(j, 1), (partner, 1)]))
            left[j] -= n
            left[partner] -= n
    return fixed, {s: n for s, n in left.items() if n > 0}


def _best_pair(sizes: list[int], left: dict[int, int], j: int, room: int) -> int:
    best, lo, hi = 0, 0, len(sizes) - 1
    while lo <= hi:
        total = sizes[lo] + sizes[hi]
        if total > room:
            hi -= 1
        else:
            if lo != hi or left[sizes[lo]] - (sizes[lo] == j) >= 2:
                best = max(best, total)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: equal sequences are handled as one group."""
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)
    open_rooms: list[int] = []

    def put(room: int, n: int, items: list[tuple[int, int]]) -> None:
        if not groups[room]:
            open_rooms.insert(bisect_left(open_rooms, room), room)
        groups[room].append((n, items))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            at = bisect_left(open_rooms, s)
            if at == len(open_rooms):
                room, m, items = capacity, -(-n // (capacity // s)), []
            else:
                room = open_rooms[at]
                m, items = groups[room].pop()
                if not groups[room]:
                    open_rooms.pop(at)
            each = room // s
            full = min(m, n // each)
            if full:
                put(room - each * s, full, [*items, (s, each)])
                m, n = m - full, n - full * each
            if m and n:  # fewer than each are left
                put(room - n * s, 1, [*items, (s, n)])
                m, n = m - 1, 0
            if m and items:
                put(room, m, items)
    return [g for room in groups.values() for g in room]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """A row for each run of ranks of a length that goes to equal places: size, lo (first rank), copies in
    a sequence, seq (first sequence), at (offset of the first copy). Ordered by size, lo."""
    fixed, rest = reduce_instance(counts, capacity)
    rows, next_rank, seq = [], defaultdict(int), 0
    for n, items in [*fixed, *best_fit(rest, capacity)]:
        at = 0
        for s, copies in items:
            rows.append((s, next_rank[s], copies, seq, at))
            next_rank[s] += n * copies
            at += s * copies
        seq += n
    return pd.DataFrame(sorted(rows), columns=["size", "lo", "copies", "seq", "at"]).astype("int64")


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, *, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut where longer than
    capacity so that only the first piece is shorter."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def packed(ids: list[int]) -> bytes:
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def run(batches):
        cache = _caches.get(tokenizer_path)
        if cache is None:
            cache = _caches[tokenizer_path] = Cache(tokenizer_path, packed)
        for b in batches:
            rows = []
            for doc, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                ids = end
                if t:
                    first, rest = chunks(t)
                    ids = cache.alone(first) + b"".join(map(cache.__getitem__, rest)) + end
                    cache.trim()
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                rows += [(doc, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, *, text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty and gives the end id alone; an empty table gives no rows; repeated rows are packed
    each; other columns are ignored. Ties in length are broken by doc_id and piece, and equal ones freely.
    """
    pieces = cut(tokenized_pieces(docs, tokenizer_path, text=text, capacity=capacity, end_id=end_id), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    total = sum(counts.values())
    parts = max(1, -(-total // RANK_ROWS))
    places = pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    rows = pieces.withColumn("_part", part)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = rows.withColumn("_rank", F.row_number().over(own) - 1).join(offsets, ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches):
        p = places.value
        keys = (p["size"].to_numpy() << 48) | p["lo"].to_numpy()
        lo, copies, seq, at = (p[c].to_numpy() for c in ("lo", "copies", "seq", "at"))
        for b in batches:
            length, rank = b["length"].to_numpy(), b.pop("_rank").to_numpy()
            k = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            d = rank - lo[k]
            yield b.assign(sequence_id=seq[k] + d // copies[k], offset=at[k] + d % copies[k] * length)

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
