"""A training corpus from raw documents, in stages that each work on what the one before kept.

Quality rules reject documents; near-repeats of earlier lines are taken out; one document of
each group of near-duplicates stays; sources are interleaved to their target weights; and
the mix is packed into token sequences. Each stage takes and gives the columns of
``documents`` except the last, which gives the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarespark.llm.line_dedup import drop_repeated_lines
from rarespark.llm.mixing import mix_documents
from rarespark.llm.near_dup import drop_near_duplicates
from rarespark.llm.packing import pack_documents
from rarespark.llm.quality import keep_good_documents
from rarespark.llm.queries import vocabulary
from rarespark.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the label model thinks good."""
    return keep_good_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are like an earlier line; documents left without a word go."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links from similarity 0.75 on."""
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of their slots; those of sources below their weight come again."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, with the ids of the documents in each."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json")).withColumn("doc_ids", F.col("pieces.doc_id"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packing),
]

# the label model and the tokenizer can't be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
