"""Corpus pipeline: toxic documents out, frequent lines out, near copies out, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All but
the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabcal.llm.common import stored, table
from tabcal.llm.line_dedup import dedup_lines
from tabcal.llm.minhash_forest import drop_near_duplicates
from tabcal.llm.sentence_pieces import encode_pieces
from tabcal.llm.source_mixing import letter_share, mix_sources, word_count
from tabcal.llm.toxicity import learn, score_toxicity

#: Least share in percent of equal shingles (Jaccard) at which two documents are near copies.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Labels of rows whose crc32(doc_id) is divisible by 5 are not learned from."""
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents stay in one; a document that loses all its lines stays with an empty text."""
    kept = dedup_lines(docs)
    kind = docs.schema["n_chars"].dataType
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays. Near copies share 80% (NEAR_PERCENT) of their shingles of five
    words; op5 has its own 85 by its contract."""
    return drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    mixed = mix_sources(docs, word_count(F.col("text")), letter_share(F.col("text")), size_col="_size", copies_col="_copies")
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and the piece ids of each row."""
    return encode_pieces(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", mix),
    ("sentencepiece", sentence_pieces),
]
#: Scores, near copies and piece ids have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
