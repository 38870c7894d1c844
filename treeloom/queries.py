"""Registered queries of the engine's own operators, over tables that stand for manifests.

An order is a file: its path is its padded key. Its line items are chunks: the part is the digest, the
quantity the length. ``wanted`` is the new state, ``had`` holds the items shipped before a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import chunking, hashing, paths, units
from treeloom.operators import diff, layout, manifest, verify
from treeloom.plans import delta
from treeloom.runtime import cut, prepare

DAY = "1995-06-17"
ROLES = ["config", "index", "tokenizer", "metadata", "other", "weight"]
PIN = chunking.Options(256, 64, 1024)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _path(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 12, "0")


def item_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, key, chunk_idx, offset, length, digest."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_partkey", "l_quantity")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    length = F.col("l_quantity").cast("long")
    rows = items.select("l_orderkey", F.row_number().over(order).alias("chunk_idx"), F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), length.alias("length"), F.col("l_partkey").alias("digest"))
    return rows.select(_path("l_orderkey").alias("path"), F.col("l_orderkey").alias("key"), "chunk_idx", "offset", "length", "digest")


def order_files(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """path, key, size, digest, role of every order, those without items too."""
    sums = chunks.groupBy("key").agg(F.sum("length").alias("size"), F.sum(F.col("digest") * F.col("chunk_idx")).alias("digest"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    files = read(spark, sf_dir, "orders").select(_path("o_orderkey").alias("path"), F.col("o_orderkey").alias("key"), role.alias("role"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return files.join(sums, "key", "left").select("path", "key", zero("size"), zero("digest"), "role")


#: The same tables for the SQL engine.
TABLES = f"""
WITH items AS (
  SELECT l_orderkey AS key, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS path, l_shipdate < TIMESTAMP '{DAY}' AS early,
         CAST(l_quantity AS BIGINT) AS length, l_partkey AS digest, l_linenumber, l_suppkey, l_extendedprice, l_shipdate FROM lineitem
), wc AS (
  SELECT path, key, row_number() OVER w AS chunk_idx, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, digest
  FROM items WINDOW w AS (PARTITION BY key ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_shipdate)
), hc AS (
  SELECT path, key, row_number() OVER w AS chunk_idx, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length, digest
  FROM items WHERE early WINDOW w AS (PARTITION BY key ORDER BY l_linenumber, l_suppkey, l_extendedprice, l_shipdate)
), o AS (
  SELECT o_orderkey AS key, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, (['{"', '".join(ROLES)}'])[CAST(o_orderkey % 6 + 1 AS INT)] AS role FROM orders
), wf AS (
  SELECT o.path, o.key, CAST(coalesce(sum(length), 0) AS BIGINT) AS size, CAST(coalesce(sum(digest * chunk_idx), 0) AS BIGINT) AS digest, role FROM o LEFT JOIN wc USING (key) GROUP BY ALL
), hf AS (
  SELECT o.path, o.key, CAST(coalesce(sum(length), 0) AS BIGINT) AS size, CAST(coalesce(sum(digest * chunk_idx), 0) AS BIGINT) AS digest, role FROM o LEFT JOIN hc USING (key) GROUP BY ALL
)"""


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(had files, had chunks, wanted files, wanted chunks). The items are read and ordered once for both states, and
    their tables are cut, as plans use them many times."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate", "l_partkey", F.col("l_quantity").cast("long").alias("length"))
    early = F.col("l_shipdate") < F.lit(DAY).cast("timestamp")
    items = items.withColumn("early", F.coalesce(early, F.lit(False)))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    rows = items.select("l_orderkey", "length", F.col("l_partkey").alias("digest"), "early", before(F.lit(1)).alias("wi"), before("length").alias("wo"), before(F.col("early").cast("int")).alias("hi"), before(F.when(F.col("early"), F.col("length")).otherwise(0)).alias("ho"))
    rows = cut(rows.select(_path("l_orderkey").alias("path"), F.col("l_orderkey").alias("key"), "length", "digest", "early", "wi", "wo", "hi", "ho"), "items")
    chunks = lambda i, o: [F.col("path"), F.col("key"), (F.col(i) + 1).cast("int").alias("chunk_idx"), F.col(o).alias("offset"), F.col("length"), F.col("digest")]
    wc, hc = rows.select(*chunks("wi", "wo")), rows.filter("early").select(*chunks("hi", "ho"))
    of = lambda i: F.col("digest") * (F.col(i) + 1)
    sums = rows.groupBy("key").agg(F.sum("length").alias("ws"), F.sum(of("wi")).alias("wd"), F.sum(F.when(F.col("early"), F.col("length"))).alias("hs"), F.sum(F.when(F.col("early"), of("hi"))).alias("hd"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    files = read(spark, sf_dir, "orders").select(_path("o_orderkey").alias("path"), F.col("o_orderkey").alias("key"), role.alias("role")).join(sums, "key", "left")
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    files = cut(files.select("path", "key", *[zero(c, c) for c in ("ws", "wd", "hs", "hd")], "role"), "files")
    state = lambda size, digest: files.select("path", "key", F.col(size).alias("size"), F.col(digest).alias("digest"), "role")
    return state("hs", "hd"), hc, state("ws", "wd"), wc


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(had files, had chunks, wanted files, wanted chunks) of the diff: some files are on one side alone."""
    hf, hc, wf, wc = states(spark, sf_dir)
    return hf.filter("key % 10 <> 3"), hc.filter("key % 10 <> 3"), wf.filter("key % 10 <> 7"), wc.filter("key % 10 <> 7")


DIFF = TABLES + """, oldf AS (SELECT * FROM hf WHERE key % 10 <> 3), oldc AS (SELECT * FROM hc WHERE key % 10 <> 3), newf AS (SELECT * FROM wf WHERE key % 10 <> 7),
newc AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path, chunk_idx) = 1 AND digest NOT IN (SELECT digest FROM oldc) AS is_new FROM wc WHERE key % 10 <> 7),
d AS (
  SELECT coalesce(n.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.digest = p.digest AND n.size = p.size THEN 'unchanged' ELSE 'modified' END AS change,
         coalesce(p.size, 0) AS old_size, coalesce(n.size, 0) AS new_size,
         CAST(coalesce((SELECT sum(length) FROM newc c WHERE c.path = n.path AND NOT is_new), 0) AS BIGINT) AS shared_bytes,
         CAST(coalesce((SELECT sum(length) FROM newc c WHERE c.path = n.path AND is_new), 0) AS BIGINT) AS new_bytes,
         CAST((SELECT count(*) FROM newc c WHERE c.path = n.path AND is_new) AS BIGINT) AS new_chunks
  FROM newf n FULL OUTER JOIN oldf p ON n.path = p.path
), t AS (
  SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged,
         CAST(sum(old_size) AS BIGINT) AS old_bytes, CAST(sum(new_size) AS BIGINT) AS new_bytes, CAST(sum(shared_bytes) AS BIGINT) AS reusable_bytes, CAST(sum(new_bytes) AS BIGINT) AS transfer_bytes FROM d
)"""


def diff_files(spark, sf_dir):
    return diff.file_diffs(*both(spark, sf_dir))


def diff_totals(spark, sf_dir):
    return diff.diff_totals(diff_files(spark, sf_dir)).drop("similarity")


def diff_similarity(spark, sf_dir):
    return diff.diff_totals(diff_files(spark, sf_dir)).select(F.round("similarity", 9).alias("similarity"))


def diff_top_changed(spark, sf_dir):
    return diff.top_changed(diff_files(spark, sf_dir), 20)


def new_digests(spark, sf_dir):
    _, hc, _, wc = both(spark, sf_dir)
    return wc.select("digest").distinct().join(hc.select("digest").distinct(), "digest", "left_anti")


def shared_digests(spark, sf_dir):
    _, hc, _, wc = both(spark, sf_dir)
    return wc.select("digest").intersect(hc.select("digest"))


def all_digests(spark, sf_dir):
    _, hc, _, wc = both(spark, sf_dir)
    return wc.select("digest").unionByName(hc.select("digest")).distinct()


def unique_chunks(spark, sf_dir):
    return manifest.unique_chunks(item_chunks(spark, sf_dir))


def digest_lengths(spark, sf_dir):
    return manifest.digest_lengths(item_chunks(spark, sf_dir))


def model_summary(spark, sf_dir):
    return manifest.model_summary(order_files(spark, sf_dir, item_chunks(spark, sf_dir)))


def manifest_summary(spark, sf_dir):
    chunks = item_chunks(spark, sf_dir)
    return manifest.manifest_summary(order_files(spark, sf_dir, chunks), chunks).withColumn("dedup_ratio", F.round("dedup_ratio", 9))


def running_offsets(spark, sf_dir):
    return manifest.running_offsets(item_chunks(spark, sf_dir).drop("offset")).select("path", "chunk_idx", "offset")


def damaged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Files and chunks with every kind of fault."""
    chunks = item_chunks(spark, sf_dir)
    files = order_files(spark, sf_dir, chunks)
    chunks = chunks.withColumn("offset", F.when(F.col("key") % 13 == 5, F.col("offset") + 1).otherwise(F.col("offset"))).withColumn("length", F.when((F.col("key") % 17 == 3) & (F.col("chunk_idx") == 2), 0).otherwise(F.col("length")))
    return files.union(files.filter("key % 19 = 4")), chunks


def validate_contiguity(spark, sf_dir):
    return manifest.chunk_violations(damaged(spark, sf_dir)[1])


def validate_coverage(spark, sf_dir):
    return manifest.coverage_violations(*damaged(spark, sf_dir)).distinct()


def validate_duplicates(spark, sf_dir):
    return manifest.duplicate_paths(damaged(spark, sf_dir)[0])


DAMAGED = TABLES + """, c AS (SELECT path, key, chunk_idx, "offset" + CASE WHEN key % 13 = 5 THEN 1 ELSE 0 END AS "offset", CASE WHEN key % 17 = 3 AND chunk_idx = 2 THEN 0 ELSE length END AS length FROM wc),
f AS (SELECT * FROM wf UNION ALL SELECT * FROM wf WHERE key % 19 = 4)"""

ODD_PATHS = ["", "/abs", "a\\b", "a//b", "a/", "./a", "a/./b", "a/../b", "..", "../a", "a/..", ".treeloom", ".treeloom/x", "ok", "a/b/c.bin", "..a/b", "a/...", ".", "a\tb"]


def validate_paths(spark, sf_dir):
    odd = F.element_at(F.array(*map(F.lit, ODD_PATHS)), (F.col("o_orderkey") % len(ODD_PATHS) + 1).cast("int"))
    files = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, odd).otherwise(F.concat(odd, F.lit("x"), F.col("o_orderkey"))).alias("path"))
    return manifest.path_violations(files).groupBy("path", "problem").agg(F.count("*").alias("n"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _odd_sql() -> str:
    from treeloom.functions.paths import path_problem

    cases = "\n".join(f"WHEN path = {_literal(p)} THEN {_literal(path_problem(p)) if path_problem(p) else 'NULL'}" for p in ODD_PATHS)
    listed = ", ".join(map(_literal, ODD_PATHS))
    return f"""
    WITH p AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN odd ELSE odd || 'x' || o_orderkey END AS path
               FROM (SELECT o_orderkey, ([{listed}])[CAST(o_orderkey % {len(ODD_PATHS)} + 1 AS INT)] AS odd FROM orders)),
    q AS (SELECT path, CASE {cases}
      WHEN path LIKE '/%' THEN 'absolute path' WHEN path LIKE '%\\%' THEN 'backslash in path'
      WHEN list_contains(string_split(path, '/'), '') OR list_contains(string_split(path, '/'), '.') OR path LIKE '%_/../%' AND path NOT LIKE '../%' THEN 'unclean path'
      WHEN path LIKE '../%' THEN 'path escapes root' WHEN path LIKE '.treeloom/%' THEN 'path inside state folder' END AS problem FROM p)
    SELECT path, problem, count(*) AS n FROM q WHERE problem IS NOT NULL GROUP BY ALL"""


NAMES = ["config.json", "a.index.json", "tokenizer.model", "README.md", "part.safetensors", "x.gguf", "weights.bin", "blob", "spm.model", "LICENSE", "noext", "a.b.PT", ".gitignore", "notes.txt", "vocab.json", "Params.JSON"]


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, path, size: each customer's orders as a tree; some trees hold blobs and their lists."""
    k = F.col("o_orderkey")
    tree = F.col("o_custkey") % 50
    name = F.element_at(F.array(*map(F.lit, NAMES)), (k % len(NAMES) + 1).cast("int"))
    plain = F.when(tree % 5 == 1, F.when(k % 2 == 0, "notes.txt").otherwise("x.gguf")).when(tree % 5 == 2, F.when(k % 3 == 0, "weights.bin").otherwise("run.pt")).otherwise(name)
    shard = F.format_string("model-%05d-of-%05d.safetensors", k % 4 + 1, F.lit(4).cast("long"))
    path = (
        F.when((tree % 5 == 0) & (k % 3 > 0), F.concat(F.lit("blobs/sha256-"), F.sha2(k.cast("string").cast("binary"), 256)))
        .when(tree % 5 == 0, F.concat(F.lit("manifests/m"), k.cast("string")))
        .when((tree % 5 == 3) & (k % 2 == 0), F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"), (F.floor(k / 4) % 11).cast("string"), shard))
        .otherwise(F.concat(F.lit("d"), k.cast("string"), F.lit("/"), plain))
    )
    return read(spark, sf_dir, "orders").select(tree.alias("tree"), path.alias("path"), (k * 7919 % 200 * 1048576 + k % 1000).alias("size"), k.alias("key"))


NAMED = f"""
WITH n0 AS (SELECT o_orderkey AS key, o_custkey % 50 AS tree, ([{", ".join(map(_literal, NAMES))}])[CAST(o_orderkey % {len(NAMES)} + 1 AS INT)] AS name FROM orders),
n AS (SELECT key, tree, key * 7919 % 200 * 1048576 + key % 1000 AS size,
  CASE WHEN tree % 5 = 0 AND key % 3 > 0 THEN 'blobs/sha256-' || sha256(CAST(key AS VARCHAR))
       WHEN tree % 5 = 0 THEN 'manifests/m' || key
       WHEN tree % 5 = 3 AND key % 2 = 0 THEN 'd' || (key % 7) || '/' || ((key // 4) % 11) || printf('model-%05d-of-%05d.safetensors', key % 4 + 1, 4)
       ELSE 'd' || key || '/' || CASE WHEN tree % 5 = 1 THEN CASE WHEN key % 2 = 0 THEN 'notes.txt' ELSE 'x.gguf' END WHEN tree % 5 = 2 THEN CASE WHEN key % 3 = 0 THEN 'weights.bin' ELSE 'run.pt' END ELSE name END END AS path FROM n0),
b AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS base, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '[.][^.]*$')) AS ext FROM n),
k AS (SELECT tree, CASE WHEN bool_or(path LIKE 'blobs/sha256-%') AND bool_or(path LIKE 'manifests/%') THEN 'ollama' WHEN bool_or(ext = '.gguf') AND NOT bool_or(ext = '.safetensors') THEN 'gguf'
  WHEN bool_or(ext = '.safetensors') OR bool_or(base LIKE '%.index.json') THEN 'huggingface' ELSE 'generic' END AS kind FROM b GROUP BY tree),
r AS (SELECT tree, key, path, size, base, CASE WHEN kind = 'ollama' AND path LIKE 'blobs/sha256-%' THEN CASE WHEN size >= 1048576 THEN 'weight' ELSE 'metadata' END
  WHEN base LIKE '%.index.json' THEN 'index' WHEN base IN ('config.json', 'params.json') THEN 'config' WHEN base LIKE 'tokenizer%' OR base = 'vocab.json' THEN 'tokenizer'
  WHEN ext IN ('.md', '.txt', '.json') OR base = 'license' THEN 'metadata' WHEN ext = '.model' AND size < 67108864 THEN 'tokenizer'
  WHEN ext IN ('.safetensors', '.gguf', '.bin', '.pt', '.model') THEN 'weight' ELSE 'other' END AS role FROM b JOIN k USING (tree))"""


def roles(spark, sf_dir):
    return layout.with_roles(named_files(spark, sf_dir), "tree").select("tree", "path", "role")


def layout_kind(spark, sf_dir):
    return layout.kinds(named_files(spark, sf_dir), "tree")


def layout_totals(spark, sf_dir):
    return layout.totals(layout.with_roles(named_files(spark, sf_dir), "tree"), "tree")


def shard_sets(spark, sf_dir):
    sets = layout.shard_sets(layout.with_roles(named_files(spark, sf_dir), "tree"), "tree")
    return sets.withColumn("parts", F.array_join("parts", ","))


def transfer_order(spark, sf_dir):
    files = layout.with_roles(named_files(spark, sf_dir), "tree")
    order = Window.partitionBy("tree").orderBy(*layout.transfer_order(files), "key")
    return files.select("tree", "path", "key", F.row_number().over(order).alias("position"))


def chunk_presets(spark, sf_dir):
    files = layout.with_roles(named_files(spark, sf_dir), "tree").withColumn("size", F.col("size") * 9)
    o = chunking.options_column(F.col("role"), F.col("size"))
    return files.select("tree", "path", o["avg_size"].alias("avg_size"), o["min_size"].alias("min_size"), o["max_size"].alias("max_size"))


ROOTS = ["/m/models--org--name", "/m/plain/", "x", "", ".", "/", "a\\models--o--n--v", "/m/models--", "models-x"]


def display_name(spark, sf_dir):
    root = F.element_at(F.array(*map(F.lit, ROOTS)), (F.col("o_orderkey") % len(ROOTS) + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(root.alias("root"), paths.display_name_column(root).alias("name")).groupBy("root", "name").agg(F.count("*").alias("n"))


def _plan(spark: SparkSession, sf_dir: str, **options) -> delta.Plan:
    hf, hc, wf, wc = states(spark, sf_dir)
    wanted = wf.filter("key % 10 <> 7").select("path", "size", (F.col("key") % 5).alias("mtime_ns"), "role", "digest")
    dest = hf.filter("key % 10 <> 3").select("path", "size", (F.col("key") % 3).alias("mtime_ns"), "digest")
    cols = ["path", "chunk_idx", "offset", "length", "digest"]
    staged = wc.filter("key % 11 = 0 and key % 10 <> 7 and chunk_idx <= 2").select(cols)
    return delta.plan(wanted, wc.filter("key % 10 <> 7").select(cols), dest, hc.filter("key % 10 <> 3").select(cols), staged, delta.Options(**options))


def _plan_sql(*, dedupe: bool = True, fast: bool = False, atomic: str = "file", resume: bool = True) -> str:
    fast_sql = "d.path IS NOT NULL AND w.size = d.size AND w.key % 5 = d.key % 3" if fast else "false"
    others = "" if dedupe else "AND h.path IN (SELECT path FROM st)"
    own = "true" if atomic == "file" else "false"
    trusted = "UNION ALL SELECT c.digest, c.path, c.\"offset\", c.length, 'global' FROM w_c c JOIN st USING (path) WHERE trusted" if fast else ""
    staged = "UNION ALL SELECT digest, path, \"offset\", length, 'staged' FROM w_c WHERE key % 11 = 0 AND chunk_idx <= 2" if resume else ""
    return (
        TABLES
        + f""", w_c AS (SELECT * FROM wc WHERE key % 10 <> 7), st AS (
  SELECT w.*, d.path IS NOT NULL AS there, coalesce({fast_sql}, false) AS trusted,
         CASE WHEN d.path IS NULL THEN 'copy' WHEN coalesce({fast_sql}, false) OR w.digest = d.digest AND w.size = d.size THEN 'skip' ELSE 'update' END AS action
  FROM (SELECT * FROM wf WHERE key % 10 <> 7) w LEFT JOIN (SELECT * FROM hf WHERE key % 10 <> 3) d ON w.path = d.path
), loc AS (
  SELECT h.digest, h.path AS src_path, h."offset", h.length, CASE WHEN {own} AND s.action = 'update' THEN 'own' ELSE 'global' END AS origin
  FROM hc h LEFT JOIN st s ON h.path = s.path WHERE h.key % 10 <> 3 AND NOT coalesce(s.trusted, false) {others}
  {trusted} {staged}
), m AS (
  SELECT c.path, c.chunk_idx, c.length, c.digest, c."offset",
    row_number() OVER (PARTITION BY c.digest ORDER BY CASE s.role WHEN 'config' THEN 0 WHEN 'index' THEN 1 WHEN 'tokenizer' THEN 2 WHEN 'metadata' THEN 3 WHEN 'other' THEN 4 ELSE 5 END, c.path, c.chunk_idx) = 1
    AND c.digest NOT IN (SELECT digest FROM loc WHERE origin <> 'own') AND NOT EXISTS (SELECT 1 FROM loc x WHERE x.origin = 'own' AND x.src_path = c.path AND x.digest = c.digest) AS need
  FROM w_c c JOIN st s ON c.path = s.path WHERE s.action <> 'skip'
), fp AS (
  SELECT st.path, action, size, role, CAST(coalesce(count(*) FILTER (need), 0) AS BIGINT) AS need_chunks, CAST(coalesce(sum(length) FILTER (need), 0) AS BIGINT) AS need_bytes, CAST(coalesce(sum(length) FILTER (NOT need), 0) AS BIGINT) AS reuse_bytes
  FROM st LEFT JOIN m ON st.path = m.path GROUP BY ALL
)"""
    )


def plan_query(**options):
    return lambda spark, sf_dir: _plan(spark, sf_dir, **options).files


def plan_deletes(spark, sf_dir):
    return _plan(spark, sf_dir, delete=True).deletes


def plan_totals(spark, sf_dir):
    return _plan(spark, sf_dir).totals.withColumn("savings", F.round("savings", 9))


def plan_need(spark, sf_dir):
    return _plan(spark, sf_dir).need


def apply_summary(spark, sf_dir):
    return delta.apply_summary(_plan(spark, sf_dir, delete=True)).withColumn("savings", F.round("savings", 9))


def best_location(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return delta.best_locations(p.chunks.filter("not need"), p.locations)


TEXT_DIGEST = "sha2(cast({} AS binary), 256)"


def text_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(wanted, found) of a verify: documents as files, some missing, longer, changed or unreadable."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = F.concat(F.lit("d/"), F.col("doc_id"))
    wanted = docs.select(path.alias("path"), F.octet_length("text").cast("long").alias("size"), F.expr(TEXT_DIGEST.format("text")).alias("digest"), "text")
    now = F.when(F.col("doc_id") % 37 == 0, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 23 == 0, F.concat(F.lit("#"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    found = docs.filter("doc_id % 41 <> 0").select(path.alias("path"), now.alias("now"), F.when(F.col("doc_id") % 29 == 0, "denied").alias("error"), F.octet_length(now).cast("long").alias("size"))
    extra = docs.filter("doc_id % 31 = 0").select(F.concat(F.lit("e/"), F.col("doc_id")).alias("path"), F.lit("").alias("now"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("size"))
    return wanted, found.union(extra)


def verify_problems(spark, sf_dir):
    wanted, found = text_state(spark, sf_dir)
    checked = verify.stat_problems(wanted, found)
    read_rows = checked.filter("problem is null").select("path").join(found, "path")
    digests = read_rows.select("path", F.expr(TEXT_DIGEST.format("now")).alias("got"), F.lit(None).cast("string").alias("error"))
    return verify.digest_problems(checked, digests)


def verify_totals(spark, sf_dir):
    return verify.verify_totals(text_state(spark, sf_dir)[0], verify_problems(spark, sf_dir), verify_bad_chunks(spark, sf_dir))


def verify_extra(spark, sf_dir):
    wanted, found = text_state(spark, sf_dir)
    return verify.extra_files(found, wanted)


def _ranges(files: DataFrame, column: str) -> DataFrame:
    pieces = chunking.fixed_chunks(files.withColumn("_b", F.col(column).cast("binary")), "_b", 512)
    return pieces.select("path", "chunk_idx", "offset", "length", F.sha2("payload", 256).alias("digest"))


def verify_bad_chunks(spark, sf_dir):
    wanted, found = text_state(spark, sf_dir)
    failing = verify_problems(spark, sf_dir).filter("problem = 'digest-mismatch'")
    now = _ranges(found.join(failing.select("path"), "path", "left_semi"), "now").select("path", "chunk_idx", F.col("digest").alias("got"), F.lit(None).cast("string").alias("error"))
    return verify.bad_chunks(_ranges(wanted.join(failing.select("path"), "path", "left_semi"), "text"), failing, now)


STATE = """
WITH d AS (SELECT doc_id, 'd/' || doc_id AS path, text, CASE WHEN doc_id % 37 = 0 THEN text || 'x' WHEN doc_id % 23 = 0 THEN '#' || substr(text, 2) ELSE text END AS now FROM documents),
p AS (SELECT *, CASE WHEN doc_id % 41 = 0 THEN 'missing' WHEN doc_id % 29 = 0 THEN 'unreadable' WHEN strlen(now) <> strlen(text) THEN 'size-mismatch' WHEN sha256(now) <> sha256(text) THEN 'digest-mismatch' END AS problem FROM d)"""

#: Two texts' fixed ranges side by side, as hexadecimal digits.
RANGES = """, c AS (SELECT path, CAST(i AS INT) AS chunk_idx, CAST(i * 512 AS BIGINT) AS "offset", substr(hex(encode(text)), i * 1024 + 1, 1024) AS h, substr(hex(encode(now)), i * 1024 + 1, 1024) AS g
  FROM p, unnest(range(0, greatest(1, CAST(ceil(strlen(text) / 512.0) AS BIGINT)))) AS u(i) WHERE problem = 'digest-mismatch'),
bad AS (SELECT path, chunk_idx, "offset", CAST(length(h) // 2 AS BIGINT) AS length, sha256(unhex(h)) AS want, sha256(unhex(g)) AS got, CAST(NULL AS VARCHAR) AS error FROM c WHERE h <> g AND h <> '')"""


def fixed_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), F.col("text").cast("binary").alias("b"))
    return chunking.fixed_chunks(docs, "b", 1000).select("path", "chunk_idx", "offset", "length", F.sha2("payload", 256).alias("digest"))


def fastcdc_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return chunking.content_chunks(docs, "text", PIN).withColumn("digest", F.lower(F.hex("digest")))


def fastcdc_reassembly(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    rows = chunking.content_chunks(docs, "text", PIN, payload=True)
    whole = rows.groupBy("path").agg(F.sum("length").alias("n_bytes"), F.expr("sha2(array_join(transform(array_sort(collect_list(struct(chunk_idx, hex(payload)))), x -> x.col2), ''), 256)").alias("sha256"))
    return docs.select("path").join(whole, "path", "left").select("path", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def fastcdc_totals(spark, sf_dir):
    chunks = fastcdc_chunks(spark, sf_dir)
    return manifest.unique_chunks(chunks).join(chunks.agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes")))


def blake3_docs(spark, sf_dir):
    prepare(spark)
    return read(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(hashing.blake3_column(F.col("text").cast("binary")))).alias("blake3"))


def format_bytes(spark, sf_dir):
    """n is null where the number passes a long (and the SQL fails); ``said`` is right there too."""
    key = F.col("o_orderkey").cast("decimal(20,0)")
    n = key * key * 37 * F.element_at(F.array(*[F.lit(10**k) for k in (0, 3, 6)]), (F.col("o_orderkey") % 3 + 1).cast("int")) - F.when(F.col("o_orderkey") % 7 == 0, 10**9).otherwise(0)
    # Numbers of 32 digits are an error: digits that a double in PiB can't hold would be said wrong.
    rows = read(spark, sf_dir, "orders").select("o_orderkey", n.cast("decimal(31,0)").alias("whole"))
    fits = F.col("whole").between(-(2**63), 2**63 - 1)  # try_cast does the same at many times the cost
    return rows.select("o_orderkey", F.when(fits, F.col("whole").cast("long")).alias("n"), units.format_bytes_column(F.col("whole")).alias("said"), units.format_percent_column(F.col("o_orderkey") % 100, F.col("o_orderkey") % 150).alias("share"))


SIZES = ["", "k", "K", "kb", "KiB", " MiB", "m", "mb", "g", "GB", "gib", "b", "x", "t", "tb", "tib", "kk", "-"]


def parse_size(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, SIZES)), (F.col("o_orderkey") % len(SIZES) + 1).cast("int"))
    text = F.concat((F.col("o_orderkey") % 64).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".5").otherwise(""), suffix)
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), units.parse_size_column(text).alias("bytes"))


def truncated_paths(spark, sf_dir):
    docs = read(spark, sf_dir, "orders")
    path = F.concat(F.lit("some/long/folder/name/"), F.col("o_orderkey") * F.col("o_orderkey"))
    return docs.select("o_orderkey", units.truncate_left_column(path, 26).alias("short"), paths.basename(path).alias("base"), paths.dirname(path).alias("folder"))


RANK = "CASE role WHEN 'config' THEN 0 WHEN 'index' THEN 1 WHEN 'tokenizer' THEN 2 WHEN 'metadata' THEN 3 WHEN 'other' THEN 4 ELSE 5 END"
FILE_PLAN = " SELECT * FROM fp"

QUERIES = {
    f.__name__: f
    for f in (diff_files, diff_totals, diff_similarity, diff_top_changed, new_digests, shared_digests, all_digests, unique_chunks, digest_lengths, model_summary, manifest_summary, running_offsets,
              validate_contiguity, validate_coverage, validate_duplicates, validate_paths, roles, layout_kind, layout_totals, shard_sets, transfer_order, chunk_presets, display_name,
              plan_deletes, plan_totals, plan_need, apply_summary, best_location, verify_problems, verify_totals, verify_extra, verify_bad_chunks,
              fixed_chunks, fastcdc_chunks, fastcdc_reassembly, fastcdc_totals, blake3_docs, format_bytes, parse_size, truncated_paths)
} | {"plan_dedupe": plan_query(), "plan_no_dedupe": plan_query(dedupe=False), "plan_atomic_model": plan_query(atomic="model"), "plan_fast": plan_query(fast=True), "plan_no_resume": plan_query(resume=False)}

ORACLE_SQL = {
    "diff_files": DIFF + " SELECT * FROM d",
    "diff_totals": DIFF + " SELECT *, added + removed + modified = 0 AS identical FROM t",
    "diff_similarity": DIFF + " SELECT round(CASE WHEN new_bytes = 0 THEN 1.0 ELSE reusable_bytes / new_bytes END, 9) AS similarity FROM t",
    "diff_top_changed": DIFF + " SELECT * FROM d WHERE change <> 'unchanged' ORDER BY new_bytes DESC, path LIMIT 20",
    "new_digests": DIFF + " SELECT DISTINCT digest FROM newc WHERE digest NOT IN (SELECT digest FROM oldc)",
    "shared_digests": DIFF + " SELECT digest FROM newc INTERSECT SELECT digest FROM oldc",
    "all_digests": DIFF + " SELECT digest FROM newc UNION SELECT digest FROM oldc",
    "unique_chunks": TABLES + " SELECT count(*) AS unique_chunks, CAST(sum(length) AS BIGINT) AS unique_bytes FROM (SELECT length FROM wc QUALIFY row_number() OVER (PARTITION BY digest ORDER BY path, chunk_idx) = 1)",
    "digest_lengths": TABLES + " SELECT digest, length FROM wc QUALIFY row_number() OVER (PARTITION BY digest ORDER BY path DESC, chunk_idx DESC) = 1",
    "model_summary": TABLES + " SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (role = 'weight') AS weight_files, CAST(coalesce(sum(size) FILTER (role = 'weight'), 0) AS BIGINT) AS weight_bytes FROM wf",
    "manifest_summary": TABLES + """, u AS (SELECT count(*) AS unique_chunks, CAST(sum(length) AS BIGINT) AS unique_bytes FROM (SELECT length FROM wc QUALIFY row_number() OVER (PARTITION BY digest ORDER BY path, chunk_idx) = 1)),
        s AS (SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS size, count(*) FILTER (role = 'weight') AS weight_files, CAST(sum(size) FILTER (role = 'weight') AS BIGINT) AS weight_bytes FROM wf)
        SELECT *, (SELECT count(*) FROM wc) AS total_chunks, round(1 - unique_bytes / size, 9) AS dedup_ratio FROM s, u""",
    "running_offsets": TABLES + ' SELECT path, chunk_idx, "offset" FROM wc',
    "validate_contiguity": DAMAGED + """ SELECT path, chunk_idx, problem FROM (SELECT path, chunk_idx, CASE WHEN "offset" <> coalesce(sum(length) OVER (PARTITION BY path ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 'not contiguous' WHEN length = 0 THEN 'zero length' END AS problem FROM c) WHERE problem IS NOT NULL""",
    "validate_coverage": DAMAGED + " SELECT DISTINCT f.path, f.size, CAST(coalesce(s.covered, 0) AS BIGINT) AS covered FROM f LEFT JOIN (SELECT path, sum(length) AS covered FROM c GROUP BY 1) s USING (path) WHERE f.size <> coalesce(s.covered, 0)",
    "validate_duplicates": DAMAGED + " SELECT path, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1",
    "validate_paths": _odd_sql(),
    "roles": NAMED + " SELECT tree, path, role FROM r",
    "layout_kind": NAMED + " SELECT * FROM k",
    "layout_totals": NAMED + " SELECT tree, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (role = 'weight') AS weight_files, CAST(coalesce(sum(size) FILTER (role = 'weight'), 0) AS BIGINT) AS weight_bytes FROM r GROUP BY 1",
    "shard_sets": NAMED + """, s AS (SELECT tree, path, size, regexp_extract(path, '^(.*?)-[0-9]{2,6}-of-([0-9]{2,6})([.][A-Za-z0-9]+)$', 1) || '.safetensors' AS name, CAST(regexp_extract(path, '-of-([0-9]+)', 1) AS INT) AS total FROM r WHERE role = 'weight' AND path LIKE '%-of-%')
        SELECT tree, name, string_agg(path, ',' ORDER BY path) AS parts, min(total) AS total, CAST(sum(size) AS BIGINT) AS size, count(*) = min(total) AS complete FROM s GROUP BY ALL""",
    "transfer_order": NAMED + f" SELECT tree, path, key, row_number() OVER (PARTITION BY tree ORDER BY {RANK}, path, key) AS position FROM r",
    "chunk_presets": NAMED + """ SELECT tree, path, CASE WHEN role = 'weight' AND size * 9 >= 1073741824 THEN 4194304 WHEN role = 'weight' AND size * 9 >= 67108864 THEN 1048576 ELSE 65536 END AS avg_size,
        CASE WHEN role = 'weight' AND size * 9 >= 1073741824 THEN 1048576 WHEN role = 'weight' AND size * 9 >= 67108864 THEN 262144 ELSE 16384 END AS min_size,
        CASE WHEN role = 'weight' AND size * 9 >= 1073741824 THEN 16777216 WHEN role = 'weight' AND size * 9 >= 67108864 THEN 4194304 ELSE 262144 END AS max_size FROM r""",
    "display_name": f"SELECT root, CASE root {' '.join(f'WHEN {_literal(r)} THEN {_literal(paths.display_name(r))}' for r in ROOTS)} END AS name, count(*) AS n FROM (SELECT ([{', '.join(map(_literal, ROOTS))}])[CAST(o_orderkey % {len(ROOTS)} + 1 AS INT)] AS root FROM orders) GROUP BY ALL",
    "plan_deletes": _plan_sql() + " SELECT path FROM hf WHERE key % 10 <> 3 AND path NOT IN (SELECT path FROM st)",
    "plan_totals": _plan_sql() + """, t AS (SELECT count(*) AS total_files, count(*) FILTER (action = 'copy') AS copy_files, count(*) FILTER (action = 'update') AS update_files, count(*) FILTER (action = 'skip') AS skip_files,
        CAST(sum(size) AS BIGINT) AS total_bytes, CAST(sum(need_bytes) AS BIGINT) AS need_bytes, CAST(sum(reuse_bytes) AS BIGINT) AS reuse_bytes, CAST(coalesce(sum(size) FILTER (action = 'skip'), 0) AS BIGINT) AS skip_bytes FROM fp)
        SELECT *, round(1 - need_bytes / total_bytes, 9) AS savings FROM t""",
    "plan_need": _plan_sql() + " SELECT path, chunk_idx, digest, length FROM m WHERE need",
    "apply_summary": _plan_sql() + """, s AS (SELECT DISTINCT path, digest FROM m WHERE need), x AS (SELECT m.*, s.path IS NOT NULL AS sent FROM m LEFT JOIN s USING (path, digest)),
        g AS (SELECT CAST(coalesce(sum(length) FILTER (sent), 0) AS BIGINT) AS received_bytes, CAST(coalesce(sum(length) FILTER (NOT sent), 0) AS BIGINT) AS reused_bytes FROM x),
        h AS (SELECT count(*) FILTER (action <> 'skip') AS written_files, count(*) FILTER (action = 'skip') AS skipped_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM fp)
        SELECT *, (SELECT count(*) FROM hf WHERE key % 10 <> 3 AND path NOT IN (SELECT path FROM st)) AS deleted_files, round(1 - received_bytes / total_bytes, 9) AS savings FROM g, h""",
    "best_location": _plan_sql() + """ SELECT m.path, m.chunk_idx, m.digest, src_path, loc."offset" AS src_offset, origin FROM m JOIN loc ON m.digest = loc.digest AND (origin <> 'own' OR src_path = m.path) WHERE NOT need
        QUALIFY row_number() OVER (PARTITION BY m.path, m.chunk_idx ORDER BY CASE origin WHEN 'own' THEN 0 WHEN 'staged' THEN 1 ELSE 2 END, src_path, loc."offset") = 1""",
    "plan_dedupe": _plan_sql() + FILE_PLAN,
    "plan_no_dedupe": _plan_sql(dedupe=False) + FILE_PLAN,
    "plan_atomic_model": _plan_sql(atomic="model") + FILE_PLAN,
    "plan_fast": _plan_sql(fast=True) + FILE_PLAN,
    "plan_no_resume": _plan_sql(resume=False) + FILE_PLAN,
    "verify_problems": STATE + """ SELECT path, problem, strlen(text) AS want_size, CASE WHEN problem = 'missing' THEN 0 ELSE strlen(now) END AS got_size, sha256(text) AS want, CASE WHEN problem = 'digest-mismatch' THEN sha256(now) END AS got, CASE WHEN problem = 'unreadable' THEN 'denied' END AS error FROM p WHERE problem IS NOT NULL""",
    "verify_totals": STATE + RANGES + """ SELECT (SELECT count(*) FROM p) AS files, (SELECT count(*) FROM p WHERE problem IS NULL) AS files_ok, CAST((SELECT sum(strlen(text)) FROM p WHERE coalesce(problem, '') NOT IN ('missing', 'size-mismatch')) AS BIGINT) AS bytes_checked, CAST(coalesce(sum(length), 0) AS BIGINT) AS bad_bytes FROM bad""",
    "verify_extra": "SELECT 'e/' || doc_id AS path FROM documents WHERE doc_id % 31 = 0",
    "verify_bad_chunks": STATE + RANGES + " SELECT * FROM bad",
    "fixed_chunks": """SELECT 'd/' || doc_id AS path, CAST(i AS INT) AS chunk_idx, CAST(i * 1000 AS BIGINT) AS "offset", CAST(length(substr(hex(encode(text)), i * 2000 + 1, 2000)) // 2 AS BIGINT) AS length, sha256(unhex(substr(hex(encode(text)), i * 2000 + 1, 2000))) AS digest
        FROM documents, unnest(range(0, CAST(ceil(strlen(text) / 1000.0) AS BIGINT))) AS u(i)""",
    "fastcdc_reassembly": "SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS n_bytes, sha256(hex(encode(text))) AS sha256 FROM documents",
    "format_bytes": """WITH s AS (SELECT o_orderkey, o_orderkey * o_orderkey * 37 * ([1, 1000, 1000000])[CAST(o_orderkey % 3 + 1 AS INT)] - CASE WHEN o_orderkey % 7 = 0 THEN 1000000000 ELSE 0 END AS n FROM orders),
        v AS (SELECT *, abs(CAST(n AS DOUBLE)) AS f, CASE WHEN abs(n) >= 1125899906842624 THEN 5 WHEN abs(n) >= 1099511627776 THEN 4 WHEN abs(n) >= 1073741824 THEN 3 WHEN abs(n) >= 1048576 THEN 2 WHEN abs(n) >= 1024 THEN 1 ELSE 0 END AS k FROM s)
        SELECT o_orderkey, CAST(n AS BIGINT) AS n, CASE WHEN n < 0 THEN '-' ELSE '' END || CASE WHEN k = 0 THEN CAST(abs(n) AS VARCHAR) WHEN f / pow(1024, k) >= 100 THEN printf('%.0f', f / pow(1024, k)) ELSE printf('%.1f', f / pow(1024, k)) END || ' ' || (['B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'])[k + 1] AS said,
          CASE WHEN o_orderkey % 150 <= 0 THEN '100%' ELSE printf('%.0f', 100.0 * (o_orderkey % 100) / (o_orderkey % 150)) || '%' END AS share FROM v""",
    "parse_size": f"""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 64 AS VARCHAR) || CASE WHEN o_orderkey % 5 = 0 THEN '.5' ELSE '' END AS num, ([{", ".join(map(_literal, SIZES))}])[CAST(o_orderkey % {len(SIZES)} + 1 AS INT)] AS suffix FROM orders)
        SELECT o_orderkey, num || suffix AS text, CAST(floor(CAST(num AS DOUBLE) * CASE lower(trim(suffix)) WHEN '' THEN 1 WHEN 'b' THEN 1 WHEN 'k' THEN 1024 WHEN 'kib' THEN 1024 WHEN 'kb' THEN 1000 WHEN 'm' THEN 1048576 WHEN 'mib' THEN 1048576 WHEN 'mb' THEN 1000000
          WHEN 'g' THEN 1073741824 WHEN 'gib' THEN 1073741824 WHEN 'gb' THEN 1000000000 WHEN 't' THEN 1099511627776 WHEN 'tib' THEN 1099511627776 WHEN 'tb' THEN 1000000000000 END) AS BIGINT) AS bytes FROM s""",
    "truncated_paths": "SELECT o_orderkey, CASE WHEN length(p) <= 26 THEN p ELSE '...' || right(p, 23) END AS short, b AS base, 'some/long/folder/name/' AS folder FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS VARCHAR) AS b, 'some/long/folder/name/' || (o_orderkey * o_orderkey) AS p FROM orders)",
}
