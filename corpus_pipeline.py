"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes the rows that its predecessor kept, written as Parquet and read again. Decisions go by row:
rows with a null doc_id, and rows that repeat one, are documents like others in every stage but line dedup,
where rows that repeat a doc_id are parts of one document. Empty tables pass through; tables may have further
columns, of any name, and need no column but doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import decontamination, lang_id, line_dedup, near_dup, packing
from treeloom.llm.queries import BYTE_BPE, PIECES, read, tokenizer_path
from treeloom.runtime import cut, join_groups, new_path

#: SQL can't express the language model, the tokenizer or the packing; tests/llm holds each stage against brute
#: force on its own input.
ORACLE_SQL = None
#: Least score of a document's language: it must be more likely than all others together.
LEAST_SCORE = 0.5
#: Documents in which a line recurs. Copies of one document are the matter of the near-duplicate stage: were a line
#: of two documents dropped, it would get the remnants of near copies, which resemble nothing.
LINE_DOCUMENTS = 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: null texts, texts without a letter, and those of which no
    language reaches LEAST_SCORE.

    If no row names a language, nothing can be learned, and only null texts and those without a letter go."""
    model = lang_id.learn(docs.filter(~lang_id.held_out()), tokenizer_path(PIECES)) if "lang" in docs.columns else {}
    said = lang_id.identify(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text")), model or {"any": {}})
    return said.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and documents that had nothing else; n_chars follows the text."""
    given = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"], docs["text"])
    out = line_dedup.drop_recurring_lines(given, documents=LINE_DOCUMENTS)
    out = out.filter((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*[v.alias(c) for c, v in own.items()])


def _with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and that column's name."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the least doc_id (null ones come last): five words, similarity 0.8."""
    docs, row = _with_rows(docs)
    of = near_dup.link_components(docs, key=row, words=5, percent=80).select(F.col("doc_id").alias("r"), "component_id")
    several = cut(of.groupBy("component_id").count().filter("count > 1"), "groups")
    members = join_groups(of, several, ["component_id"], "count", ["r"]).join(docs.select(F.col(row).alias("r"), docs["doc_id"].alias("d")).hint("merge"), "r")
    members = cut(members, "members")
    least = cut(members.groupBy("component_id").agg(F.min(F.struct(F.col("d").isNull(), "d", "r")).alias("least"), F.count("*").alias("_n")), "least")
    gone = join_groups(members, least, ["component_id"], "_n", ["r"]).filter(F.col("r") != F.col("least.r")).select(F.col("r").alias(row))
    return docs.join(gone.hint("merge"), row, "left_anti").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    docs, row = _with_rows(docs)
    leaks = decontamination.find_leaks(docs, read(spark, sf_dir, "benchmark"), key=row).select(row).distinct()
    return docs.join(leaks.hint("merge"), row, "left_anti").drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and its place there."""
    return packing.pack(docs, tokenizer_path(BYTE_BPE), capacity=2048, end_id=0)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of what is left of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), new_path(spark, f"stage-{name}")
        schema = out.schema
        out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return docs
