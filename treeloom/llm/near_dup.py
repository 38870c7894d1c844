"""MinHash near-duplicates with min-max signatures, exact verification and exact components."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.components import components
from treeloom.runtime import cut, join_groups, prepare

#: Values of a band, and bands. A pair of similarity 0.85 shares no band with probability 6e-9, one of 0.8
#: with 5e-6. Each permutation gives two values, so 120 are evaluated for 240 values.
ROWS, BANDS = 6, 40
#: Documents of a block that is held against another.
TOGETHER = 512
#: Bits of the broadcast bitmap of candidates, least and most (32 megabytes), and bits a candidate between them.
MARKS, MOST_MARKS, MARK_BITS = 1 << 23, 1 << 28, 16
#: Pairs of one document that meet a copy of its set together.
PAIRS = 256
_rng = np.random.default_rng(20_260_101)
_A = _rng.integers(0, 2**63, ROWS * BANDS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, ROWS * BANDS // 2, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_C = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of that many words; fewer words make one run."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(w))
    s = np.full(len(w) - k + 1, len(w) if k < words else 0, np.uint64)
    for i in range(k):
        s = mix(s + h[i : len(h) - k + 1 + i] * _C[i % 5] + np.uint64(i))
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """A hash for each band, of the least and the greatest values of s under each permutation."""
    lo, hi = np.full(len(_A), 2**64 - 1, np.uint64), np.zeros(len(_A), np.uint64)
    for i in range(0, len(s), 1024):
        v = s[None, i : i + 1024] * _A[:, None] + _B[:, None]
        np.minimum(lo, v.min(1), out=lo)
        np.maximum(hi, v.max(1), out=hi)
    values = np.concatenate([lo, hi]).reshape(2, BANDS, ROWS // 2).transpose(1, 0, 2).reshape(BANDS, ROWS)
    return mix((mix(values) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _signatures(docs: DataFrame, text: str, words: int) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for doc, t in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                s = shingles(t, words)
                rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s) if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hash", "bands"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, text: str, words: int) -> DataFrame:
    """(id, set) of the documents in ids, and of a few others. Texts are not shuffled: a bitmap of hashed ids
    of a checked size is broadcast, and tells which rows to look at. Where ids are so many that it fills
    up, more rows pass; joins on id leave them out."""
    bits = min(MOST_MARKS, max(MARKS, 1 << (MARK_BITS * ids.count()).bit_length()))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b.iloc[:, 0], "set": [shingles(t, words).view(np.int64) for t in b.iloc[:, 1]]})

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = ids.groupBy(F.bitmap_bucket_number(place("id")).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("id"))).alias("_bits"))
    own = docs.filter("doc_id is not null").select("doc_id", text, F.bitmap_bucket_number(place("doc_id")).alias("_bucket"), F.bitmap_bit_position(place("doc_id")).alias("_at"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    seen = own.join(F.broadcast(marks), "_bucket").filter(byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0)
    return seen.select("doc_id", text).mapInPandas(run, "id long, set array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b, size) those whose full sets are similar enough; an a has at most size partners in any one
    bucket. The sets of an a with many partners are copied, and its pairs dealt to the copies, so that a large
    group of near copies burdens no task."""
    copies = lambda c: F.ceil(F.col(c) / PAIRS)
    pairs = cut(pairs.withColumn("part", F.pmod(F.xxhash64("b"), copies("size"))), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(_sets(docs, ids, text, words), "sets")
    # Merge joins at every size: the plan, and what it shuffles, doesn't hinge on a threshold.
    several = cut(pairs.groupBy("a").agg(F.max("size").alias("size")), "several")
    first = several.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    first = first.select("a", "sa", F.explode(F.sequence(F.lit(0).cast("long"), copies("size") - 1)).alias("part"))
    both = pairs.hint("merge").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    both = both.hint("merge").join(first, ["a", "part"])
    n = F.size("sa") + F.size("sb")
    common = F.size(F.array_intersect("sa", "sb"))
    return cut(both.withColumn("i", common).filter(100 * F.col("i") >= percent * (n - F.col("i"))).select("a", "b").distinct(), "verified")


def _common_sizes(sets: DataFrame) -> DataFrame:
    """(id, e): how many elements of each set some other set holds too."""
    alone = sets.select("id", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").count()
    return sets.select("id", F.size("set").alias("_n")).join(alone, "id", "left").select("id", (F.col("_n") - F.coalesce("count", F.lit(0))).alias("e"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Of rows (band, id, n, component) those of bands with several components, with the band's least id."""
    bands = rows.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("pivot"), F.count("*").alias("_n")).filter("lo < hi")
    return join_groups(rows, cut(bands.select("band", "pivot", "_n"), "mixed"), ["band"], "_n", ["id"])


def _between_components(rest: DataFrame, docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """(a, b): links that join all components of rest (band, id, n, component) between whose members there is a
    link, where they share bands: one from a task for each two components. Documents of which too large a part is found in no other one are out first. The others form
    clusters, by shared bands; in a cluster all members but those of its largest component are held against
    all members, in blocks: a task gets two blocks at a time and emits links alone."""
    rest = cut(rest, "rest")
    sets = cut(_sets(docs, rest.select("id").distinct(), text, words), "sets")
    able = _common_sizes(sets).join(rest.select("id", "n").distinct(), "id").filter(100 * F.col("e") >= percent * F.col("n")).select("id")
    rest = cut(_mixed(rest.join(able, "id", "left_semi")), "able")
    clusters = components(rest.filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    rows = rest.select("id", "n", "component").distinct().join(clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id")
    rows = cut(rows, "clusters")
    per = rows.groupBy("cluster", "component").count().groupBy("cluster")
    sizes = per.agg(F.sum("count").alias("g"), F.max("count").alias("most"), F.max_by("component", F.struct("count", "component")).alias("largest"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / TOGETHER))
    rows = rows.join(sizes, "cluster").withColumn("s", F.col("g") - F.col("most")).withColumn("nb", blocks("g")).withColumn("nq", blocks("s"))
    own = F.xxhash64("id")
    all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    members = rows.select("cluster", F.pmod(own, "nb").alias("b"), all_of("nq").alias("q"), F.lit(False).alias("asks"), "id", "component")
    asking = rows.filter("component <> largest").select("cluster", all_of("nb").alias("b"), F.pmod(own, "nq").alias("q"), F.lit(True).alias("asks"), "id", "component")
    dealt = members.unionByName(asking).hint("merge").join(sets, "id").repartition("cluster", "b", "q").sortWithinPartitions("cluster", "b", "q", "asks")

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        members, asking = [r for r in held if not r[0]], [r for r in held if r[0]]
        if not members or not asking:
            return []
        sizes = np.array([len(r[3]) for r in members])
        ids, component = np.array([r[1] for r in members]), np.array([r[2] for r in members])
        known, at = np.unique(np.concatenate([r[3] for r in members]), return_inverse=True)
        starts, flag, out = np.r_[0, sizes.cumsum()[:-1]], np.zeros(len(known), np.int32), {}
        for _, x, own, s in asking:
            k = np.minimum(np.searchsorted(known, s), len(known) - 1)
            k = k[known[k] == s]
            flag[k] = 1
            common = np.add.reduceat(flag[at], starts)
            flag[k] = 0
            near = (100 * common >= percent * (sizes + len(s) - common)) & (component != own)
            for y, other in zip(ids[near].tolist(), component[near].tolist(), strict=True):
                out.setdefault((min(own, other), max(own, other)), (max(x, y), min(x, y)))
        return list(out.values())

    def run(batches):
        held, last = [], None
        for b in batches:
            out = []
            for key, row in zip(zip(b["cluster"], b["b"], b["q"], strict=True), zip(b["asks"], b["id"], b["component"], b["set"], strict=True), strict=True):
                if key != last:
                    out += links(held)
                    held, last = [], key
                held.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(links(held), columns=["a", "b"], dtype="int64")

    return cut(dealt.mapInPandas(run, "a long, b long"), "between")


def link_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs.

    Documents with equal shingle sets form a class; only the least id of a class is searched. In each
    bucket of a band the members are compared with the least of them, which settles most. Where a bucket
    still holds several components, all members of different ones are compared in blocks. So no pair that
    shares a bucket loses its link, and a large group of near copies that hang together costs a comparison
    a member.

    Null or empty text has no shingles and is linked with nothing. Rows that repeat a doc_id share its
    component. Null doc_ids keep a null component and are kept. Whole texts are taken, however long. An empty
    table gives an empty result. Other columns are ignored. Another column of longs may be the key.
    """
    prepare(docs.sparkSession)
    docs = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    text = "text"
    sig = cut(_signatures(docs, text, words), "signatures")
    known = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.count("*").alias("_n")), "classes")
    reps = known.join(classes.select(F.col("id").alias("doc_id"), "set_hash"), ["doc_id", "set_hash"], "left_semi").dropDuplicates(["doc_id", "set_hash"])
    members = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    pivots = members.groupBy("band").agg(F.min("id").alias("pivot"), F.min_by("n", "id").alias("m"), F.count("*").alias("size")).filter("size > 1")
    pivots = cut(pivots.withColumn("_n", F.col("size")), "pivots")
    shared = cut(join_groups(members, pivots, ["band"], "_n", ["id"]), "shared")
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = shared.filter((F.col("id") != F.col("pivot")) & alike).groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("size").alias("size"))
    links = _verified(pairs, docs, text, words, percent)
    labels = components(links)
    labelled = shared.select("band", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = cut(labelled, "labelled")
    more = _between_components(_mixed(labelled).drop("pivot"), docs, text, words, percent)
    # Stars of the components so far, and the links between them, make the final ones.
    labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    of_class = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("set_hash", "_n", F.coalesce("component", "id").alias("component"))
    # A class may have an id that another class holds too, if a doc_id repeats with other text.
    of_class = cut(of_class, "of_class")
    out = join_groups(known.select("doc_id", "set_hash"), of_class, ["set_hash"], "_n", ["doc_id"]).groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sig.join(out, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id"))).alias("kept"))
