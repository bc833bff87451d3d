"""The pipeline's stages against the operators' own verdicts, and its queries against DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simplicia.llm import mixing, near_dedup, quality, queries, toxicity
from simplicia.llm.shared import read, written
from test_operators import NASTY

TABLES = "documents embeddings pages conversations labels benchmark".split()


def rows(df):
    return Counter(repr(r.asDict()) for r in df.collect())


def test_stages_apply_their_operators(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels")
    stages = dict(corpus_pipeline.STAGES)
    toxic = toxicity.score_toxicity(docs, labels).where("predicted = 1").select("doc_id")
    one = stages["toxicity"](spark, docs, sf_dir)
    assert rows(one) == rows(docs.join(toxic, "doc_id", "left_anti").select(docs.columns))
    two = stages["quality"](spark, one, sf_dir)
    kept = quality.judge_quality(one).where("kept").select("doc_id")
    assert rows(two) == rows(one.join(kept, "doc_id", "left_semi").select(docs.columns))
    three = stages["near_dedup"](spark, two, sf_dir)
    kept = near_dedup.near_duplicates(two).where("kept").select("doc_id")
    assert rows(three) == rows(two.join(kept, "doc_id", "left_semi").select(docs.columns))
    four = stages["mixing"](spark, three, sf_dir)
    plan = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.plan_mix(three).collect() if r["size"]}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({k: v for k, v in plan.items() if v})
    five = stages["sentence_pieces"](spark, four, sf_dir)
    assert five.count() == four.count()
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(five)


def test_stages_take_empty_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_take_nasty_rows(spark, sf_dir):
    """Nulls, repeats, empty and long texts and clashing columns, through all stages one after the other."""
    docs = spark.createDataFrame(NASTY, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.lit(1), "a.b": F.lit(2), "__gone": F.lit("own"), "size": F.lit(0)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = written(stage(spark, docs, sf_dir), "nasty")
        if name == "sentence_pieces":
            assert docs.count() == before and docs.where("ids IS NULL").count() == 0
        else:
            assert docs.columns == columns
    assert before > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_are_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = queries.QUERIES[name](spark, sf_dir)
    expected = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(map(repr, expected.fetchall())) == Counter(repr(tuple(r)) for r in found.select(columns).collect())
