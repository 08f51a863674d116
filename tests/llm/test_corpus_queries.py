"""Registered corpus queries against their SQL, and the pipeline's stages against each other."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tabcal.llm import load_queries
from tabcal.llm.minhash_forest import near_dedup
from tabcal.llm.toxicity import learn, score_toxicity

SF = os.environ.get("TABCAL_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def test_each_operator_has_a_query():
    names = load_queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", [n for n, (_, sql) in load_queries().items() if sql])
def test_query_equals_its_sql(spark, name):
    query, sql = load_queries()[name]
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    df = query(spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    lexicon = learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r["doc_id"] for r in score_toxicity(docs, lexicon).where("predicted = 1").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        rows = out.collect()
        if name == "sentencepiece":
            assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
            assert all(r["n_pieces"] == len(r["ids"]) for r in rows)
            continue
        assert out.columns == columns
        after = {r["doc_id"] for r in rows}
        if name == "toxicity":
            assert after == before - toxic
        elif name == "minhash_near_dedup":
            assert after == {r["doc_id"] for r in near_dedup(docs, percent=corpus_pipeline.NEAR_PERCENT).where("kept").collect()}
        elif name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "source_mixing":
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
        docs, before = out, after


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_pieces"] and out.count() > 0
