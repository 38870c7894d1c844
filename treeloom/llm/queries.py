"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontamination, lang_id, line_dedup, near_dup, nearest, packing, repeats, secret_scan, token_counts, warc

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), limit=512)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_components(read(spark, sf_dir, "documents"), words=3, percent=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), capacity=2048, end_id=0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lang_id.learn(docs.filter(~lang_id.held_out()), tokenizer_path(PIECES))
    return lang_id.identify(docs.select("doc_id", "text", lang_id.held_out().alias("held_out")), model).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decontamination.judge(docs, decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark")))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secret_scan, op3_minhash, op4_suffix_dedup, op5_line_dedup, op6_packing, op7_warc, op8_nearest, op9_lang_id, op10_decontamination)}

ORACLE_SQL = {
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents
        ), w AS (
            SELECT doc_id, line, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS t FROM l
        ), m AS (
            SELECT *, len(t) AS n, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' || chr(1) ELSE x END) AS k FROM w WHERE len(t) > 0
        ), f AS (
            SELECT * REPLACE (CASE WHEN n >= 4 AND 2 * len(list_filter(k, lambda x: x <> '*' || chr(1))) >= n THEN k ELSE t END AS k),
                   CASE WHEN n >= 10 THEN (n - 2) // 2 ELSE greatest(1, n // 3) END AS width FROM m
        ), o AS (
            SELECT *, unnest(list_distinct([2, 2 + (n - 2 - width) // 2, n - width])) AS start FROM f WHERE n >= 4
        ), k AS (
            SELECT doc_id, line, n, -1 AS kind, false AS short, n AS fixed, k AS key FROM f
            UNION ALL SELECT doc_id, line, n, start, n < 10, 0, k[1:start] || k[start + width + 1:n] FROM o
            UNION ALL SELECT doc_id, line, n, -2, false, 0, k[1:3] || k[4:n:2] FROM f WHERE n >= 10
            UNION ALL SELECT doc_id, line, n, -3, false, 0, k[1:3] || k[5:n:2] FROM f WHERE n >= 10
        ), v AS (
            SELECT *, line = min(line) OVER (PARTITION BY doc_id, n, kind, key) AS is_new
            FROM (SELECT * REPLACE (greatest(fixed, len(list_filter(key, lambda x: x <> '*' || chr(1)))) AS fixed) FROM k)
            WHERE CASE WHEN short THEN 3 * fixed >= 2 * n ELSE 2 * fixed >= n END
        ), r AS (
            SELECT n, kind, key, min(doc_id) AS least FROM v GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2 + max(CAST(short AS INT))
        ), g AS (
            SELECT DISTINCT doc_id, line FROM v JOIN r USING (n, kind, key) WHERE doc_id > least OR NOT is_new
        ), s AS (
            SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped, coalesce(string_agg(body, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS rest
            FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY 1
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(rest, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
}
