"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item is a sequence of words. Windows of a document that are as long as an item are fingerprinted by the
signs of sums over their shingles, which running sums give for all windows of a stretch; windows without a
single shingle of any item, whose similarity is nought, are passed over. A fingerprint has 16 blocks of 16
bits. Tables from the value of a block lead to the items; each item stands there under its block values and
all that differ from them in two bits at most, and a window asks for its own values. So every item whose
fingerprint lies within SURE bits of the window's is found, since one of its blocks differs in two bits at
most; and of those farther away most are. Those within FAR bits are verified by the weighted
Jaccard similarity of shingle counts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.near_dup import mix
from treeloom.runtime import prepare

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 differs in 39 of 256 bits in the mean, with a deviation of 6. All pairs within SURE
#: bits meet in some block; a pair of similarity 0.8 meets in none with probability 3e-6.
BITS, BLOCKS = 256, 16
SURE, FAR = 3 * BLOCKS - 1, 70
#: Bytes of benchmark text that are broadcast at once (its tables take some 40 times that in a worker); a
#: larger benchmark is taken in several passes. Windows that are fingerprinted at once.
PASS_BYTES, TOGETHER = 2 << 20, 8192
FOUND = "doc_id long, item_id long, start long, similarity double"
_WORD = re.compile(r"\w+")
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: What makes four hashes of one, and what makes the block values that differ from one in two bits at most.
_WIDE = np.array([0, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_NEAR = np.array(sorted({1 << i | 1 << j for i in range(16) for j in range(16)} | {0}), "<u2")


def word_hashes(text: str | None) -> np.ndarray:
    w = _WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))


def shingle_hashes(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A hash for each run of so many words, in order."""
    n = len(h) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for i in range(words):
        s = mix(s + h[i : n + i] * _C[i % 5] + np.uint64(i))
    return s


def sign_sums(s: np.ndarray) -> np.ndarray:
    """Running sums of the signs that the shingles give to each bit; one row more than s has."""
    wide = mix(s[:, None] + _WIDE).astype("<u8").view(np.uint8)
    out = np.zeros((len(s) + 1, BITS), np.int32)
    np.cumsum((np.unpackbits(wide, axis=1).astype(np.int8) << 1) - 1, axis=0, dtype=np.int32, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from lo to hi, as rows of 16-bit blocks."""
    return np.packbits(sums[hi] - sums[lo] > 0, axis=1).view("<u2")


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of shingle counts."""
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


class Index:
    """Block tables of items (item_id, text); their size follows the items' bytes alone."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        self.ids, self.counts, self.shingles = [], [], []
        ks, sizes, prints = [], [], []
        for item, text in sorted(items):
            h = word_hashes(text)
            if not len(h):
                continue
            k = min(words, len(h))
            s = shingle_hashes(h, k)
            self.ids.append(item)
            self.counts.append(Counter(s.tolist()))
            self.shingles.append(s)
            ks.append(k)
            sizes.append(len(s))
            prints.append(fingerprints(sign_sums(s), np.array([0]), np.array([len(s)])))
        self.k, self.size = np.array(ks, np.int64), np.array(sizes, np.int64)
        self.prints = np.concatenate(prints) if prints else np.empty((0, BLOCKS), "<u2")
        self.known = np.unique(np.concatenate([*self.shingles, np.empty(0, np.uint64)]))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known >> np.uint64(42)).astype(np.int64)] = True
        #: items by block value: those of slot v of block b lie from starts[b, v] to starts[b, v + 1]
        self.starts, self.held = np.empty((BLOCKS, (1 << 16) + 1), np.int64), []
        before = 0
        for b in range(BLOCKS):
            values = (self.prints[:, b, None] ^ _NEAR).astype(np.int64).ravel()
            order = np.argsort(values, kind="stable")
            self.held.append(np.repeat(np.arange(len(self.ids), dtype=np.int32), len(_NEAR))[order])
            self.starts[b] = before + np.concatenate([[0], np.bincount(values, minlength=1 << 16).cumsum()])
            before += len(values)
        self.held = np.concatenate(self.held)

    def touched(self, s: np.ndarray) -> np.ndarray:
        """Places of s that hold a shingle of some item."""
        at = np.flatnonzero(self.filter[(s >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[k] == s[at]]

    def candidates(self, prints: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): items of the windows' sizes that some block leads to, within FAR bits."""
        slots = prints + np.arange(BLOCKS, dtype=np.int64) * self.starts.shape[1]
        flat = self.starts.ravel()
        lo, n = flat[slots], flat[slots + 1] - flat[slots]
        window = np.nonzero(n)[0]
        lo, n = lo[n > 0], n[n > 0]
        item = self.held[np.repeat(lo - (n.cumsum() - n), n) + np.arange(n.sum())].astype(np.int64)
        window = np.repeat(window, n)
        fits = (self.size[item] == sizes[window]) & (self.k[item] == k)
        pairs = np.unique(window[fits] * len(self.ids) + item[fits])
        window, item = pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1, dtype=np.int64) <= FAR
        return window[near], item[near]

    def search(self, h: np.ndarray, similar: float = SIMILARITY) -> list[tuple[int, int, float]]:
        """(item, place in words, similarity): the best window of each item that some window reaches. h: hashes of
        a document's words."""
        best: dict[int, tuple[float, int]] = {}
        for k in np.unique(self.k).tolist():
            s = shingle_hashes(h, k)
            at = self.touched(s)
            if not len(at):
                continue
            sizes = np.unique(self.size[self.k == k])
            far = int(sizes[-1])
            for part in np.split(at, np.flatnonzero(np.diff(at) >= 2 * far) + 1):  # stretches that no window joins
                base, end = max(0, int(part[0]) - far), min(len(s), int(part[-1]) + far)
                sums = sign_sums(s[base:end])
                starts, ends, wanted = [], [], []
                for size in sizes.tolist():
                    marks = np.zeros(end - base + 1, np.int32)
                    np.add.at(marks, np.maximum(part - base - size + 1, 0), 1)
                    np.add.at(marks, part - base + 1, -1)
                    last = max(0, len(s) - size) - base  # the last window that ends within the text
                    inside = np.flatnonzero(marks.cumsum()[: max(1, min(end - base, last + 1))] > 0)
                    if len(s) < size:
                        inside = np.array([0])  # a text that is shorter is its only window
                    starts.append(inside)
                    ends.append(np.minimum(inside + size, end - base))
                    wanted.append(np.full(len(inside), size))
                starts, ends, wanted = np.concatenate(starts), np.concatenate(ends), np.concatenate(wanted)
                for i in range(0, len(starts), TOGETHER):
                    own, stop = starts[i : i + TOGETHER], ends[i : i + TOGETHER]
                    for w, item in zip(*(x.tolist() for x in self.candidates(fingerprints(sums, own, stop), wanted[i : i + TOGETHER], k)), strict=True):
                        lo = base + int(own[w])
                        v = similarity(Counter(s[lo : base + int(stop[w])].tolist()), self.counts[item])
                        key = self.ids[item]
                        if v >= similar and (v, -lo) > (best[key][0], -best[key][1]) if key in best else v >= similar:
                            best[key] = (v, lo)
        return [(i, at, v) for i, (v, at) in best.items()]


_indexes: dict[str, Index] = {}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", similar: float = SIMILARITY, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id (or key), item_id, start (in words), similarity: the best window for each item that a row of docs holds.

    benchmark: item_id, text. Its size is checked: up to pass_bytes it is broadcast, a larger one is taken
    in passes of about that size. An item of fewer than five words is one shingle, its whole sequence, and is
    found where that sequence stands; items without a word, null ones and those with a null id are never
    found. Rows of benchmark that repeat an item_id are searched each, and the best one is told. Ties go to the
    first window. Null texts, and texts with fewer words than an item's shingles, hold nothing; rows of docs that
    repeat a doc_id are searched each, those with a null one too, and listed under it; empty tables give an
    empty result; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    out = None
    for n in range(passes):
        part = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n))
        items = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.select("item_id", "text").collect()])
        mark = f"{spark.sparkContext.applicationId}-{items._jbroadcast.id()}"

        def run(batches, items=items, mark=mark):
            if mark not in _indexes:
                _indexes.clear()
                _indexes[mark] = Index(items.value)
            index = _indexes[mark]
            for b in batches:
                rows = [(doc, item, at, v) for doc, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True) if len(h := word_hashes(t)) for item, at, v in index.search(h, similar)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "similarity"]).astype({"doc_id": "Int64", "item_id": "int64", "start": "int64", "similarity": "float64"})

        found = docs.select(docs[key], docs[text]).mapInPandas(run, FOUND)
        out = found if out is None else out.union(found)
    if passes > 1:
        out = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"))).alias("b")).select("doc_id", "item_id", (-F.col("b.col2")).alias("start"), "b.similarity")
    return out.withColumnRenamed("doc_id", key)


def judge(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """doc_id, n_items, item_ids (ascending, comma-joined), max_similarity, contaminated for each row of docs.

    Rows that repeat a doc_id, a null one too, are judged by what any of them holds."""
    by = leaks.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_set("item_id")).alias("_items"), F.max("similarity").alias("_best"))
    own = docs.select("doc_id")
    out = own.join(by, own["doc_id"].eqNullSafe(by["_doc"]), "left")
    n = F.when(F.col("_items").isNull(), 0).otherwise(F.size("_items")).cast("long")
    return out.select("doc_id", n.alias("n_items"), F.coalesce(F.array_join(F.col("_items").cast("array<string>"), ","), F.lit("")).alias("item_ids"), F.coalesce("_best", F.lit(0.0)).alias("max_similarity"), (n > 0).alias("contaminated"))
