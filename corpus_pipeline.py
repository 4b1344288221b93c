"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Empty tables give empty tables, repeated rows and ids count as rows of their own
where a stage does not say otherwise, and columns that documents has besides are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaszcz.llm import bpe, decontam, nearcopies, suffix, toxicity
from plaszcz.llm.store import stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts hold no evidence and stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("NOT toxic").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays. Null, empty and blank texts are copies of each other."""
    return nearcopies.drop_near_copies(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that also stand elsewhere are cut from every text.

    A cut within a character's bytes takes the whole character. Null texts stay null.
    """

    cut = suffix.remove_repeats(docs, readable=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, question and answer, go. Null and empty texts hold none and stay."""
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter("size(leaks) = 0").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's token ids, and the text decoded from them; a null or empty text has no ids and decodes to an empty one."""
    return bpe.encode(docs, decoded=True).select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", F.col("decoded_text").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: The stages learn a model, follow links and rank passages, which SQL cannot express on whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's result."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = stage(docs, name)
    return docs
