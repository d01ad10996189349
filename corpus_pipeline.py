"""The corpus pipeline: five stages from raw documents to packed sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet to the shared folder and reads again for the next one. All
but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlens.llm import best_fit, near_dup, quality, scratch, suffix_dedup, toxicity
from weftlens.llm.queries import table, vocabulary

#: Some stages have no SQL form; tests/llm holds them against brute-force versions.
ORACLE_SQL = None

#: Bytes that 51 words of running text exceed: the shortest in the documents of good quality of sf0.1 have
#: 238 (en), 246 (fr), 252 (es) and 261 (de).
PASSAGE = 220


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    named = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return toxicity.score(named, model).where("predicted = 0").select("row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose combined quality score is 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    named = docs.select(F.struct(*docs.columns).alias("row"), *quality.COLUMNS)
    return quality.score(named, model).where("good = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words, or of 400 bytes, that stand at several places; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs, PASSAGE, words=51).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return best_fit.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near-duplicates", drop_near_copies), ("suffix-array", cut_repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
