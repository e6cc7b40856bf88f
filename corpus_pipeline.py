"""A corpus pipeline over `documents`: reject by quality, strip repeated passages, drop near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`. What a stage returns is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm.common import drop_written, materialize, read_table, written
from factorlake.llm.line_dedup import dedup_lines
from factorlake.llm.mixing import mixed_documents
from factorlake.llm.packing import pack
from factorlake.llm.quality import fit_on, grades, score
from factorlake.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half; all if no label fits any document."""
    model = fit_on(docs, grades(read_table(spark, sf_dir, "labels")), 3)
    return score(docs, model, keep_grade=2).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages (of several lines, or of a line of over 50 words) that stand elsewhere before; those left with no text go."""
    clean = dedup_lines(docs, passage_words=50)
    text = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    clean = clean.where("n_removed = 0 or length(trim(text)) > 0")
    return clean.withColumn("n_chars", text).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the lowest doc_id. Documents without any word have no copies.

    Shingles are of five words. A similarity of 0.8 of two texts' shingles
    stands for about 10 differing bits of 64, and 30 of 192.
    """
    return drop_near_duplicates(docs, max_bits=8, words=5, more=2, total_bits=30)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole and in part."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", quality), ("line dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote on its way is deleted once the next one's docs are stored."""
    docs, earlier = read_table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES[:-1]:
        stored = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        made = [p for p in written(spark) if p not in earlier]
        drop_written(spark, made[:-1])
        docs, earlier = stored, written(spark)[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
