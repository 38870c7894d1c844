"""Each stage of the pipeline against brute force on its own input, and run() as a whole."""

import re
from collections import Counter

import corpus_pipeline
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import SF, brute_components, brute_leaks, brute_lines, packed

from treeloom.llm import lang_id
from treeloom.llm.queries import PIECES, QUERIES, tokenizer_path


def brute_stage(spark, name, rows, docs, items):
    """Counter of (doc_id, text) that the stage keeps of rows."""
    if name == "language_id":
        model = lang_id.learn(docs.filter(~lang_id.held_out()), tokenizer_path(PIECES))
        scorer = lang_id.Scorer(model)
        return Counter((d, t) for d, t in rows if re.search(r"[^\W\d_]", t or "") and scorer.predict(t)[1] >= 0.5)
    if name == "line_dedup":
        return Counter((d, c) for d, _, n, c in brute_lines(rows, 3) if n == 0 or c.strip())
    if name == "near_duplicates":
        of = brute_components([(r, t) for r, (_, t) in enumerate(rows)], 5, 80)
        groups = {}
        for r in range(len(rows)):
            groups.setdefault(of[r][1], []).append(r)
        best = [min(g, key=lambda r: (rows[r][0] is None, rows[r][0] or 0)) for g in groups.values()]
        return Counter(rows[r][0] for r in best)  # of rows that tie for the least doc_id any one
    bad = {r for r, _ in brute_leaks([(r, t) for r, (_, t) in enumerate(rows)], items)}
    return Counter(x for r, x in enumerate(rows) if r not in bad)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in pd.read_parquet(f"{SF}/benchmark.parquet").itertuples()]
    one = "the same words of a text that two rows have which share their number and all else of it too"
    more = [(9001, None), (9002, "123 456"), (9003, ""), (None, items[0][1]), (None, one + " null"), (9005, one), (9005, one), (9005, items[1][1]), (9005, "other text of a number that comes again"), (9006, "long " * 40_000), (None, None)]
    odd = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in more], docs.schema)
    docs = docs.union(odd).withColumns({"row": F.lit(1), "gone": F.lit("x"), "score": F.lit(2.0), "_d": F.lit(3)})
    docs.write.parquet(str(tmp_path / "start"))
    docs = spark.read.parquet(str(tmp_path / "start"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "packing":
            packed(out.collect(), docs, 2048)
            break
        assert out.columns == docs.columns
        want = brute_stage(spark, name, rows, docs, items)
        got = Counter((r.doc_id, r.text) for r in out.collect())
        assert (Counter(d for d, _ in got.elements()) if name == "near_duplicates" else got) == want, name
        assert not got - Counter(rows) or name == "line_dedup"
        docs = out


def test_stages_of_poor_tables(spark):
    for rows in ([], [(1, "some words of a text"), (2, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert name == "packing" or docs.columns == ["doc_id", "text"]
        assert docs.count() == len(rows[:1])


def test_run(spark):
    """run() gives what its stages give one by one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    packed(corpus_pipeline.run(spark, SF).collect(), docs, 2048)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_apply_their_operator(spark, name):
    """Every opN_ function gives a row for each row of its table, or what its contract says."""
    out = QUERIES[name](spark, SF)
    n = out.count()
    if name == "op8_nearest":
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
        assert n == 20 * vectors.filter("vec_id % 20 = 0").count()
    elif name == "op6_packing":
        packed(out.collect(), spark.read.parquet(f"{SF}/documents.parquet"), 2048)
    else:
        table, key = ("pages", "page_id") if name == "op7_warc" else ("documents", "doc_id")
        ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
        assert Counter(r[0] for r in out.select(key).collect()) == Counter(ids)


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]
