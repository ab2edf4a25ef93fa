"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, read_table
from tidemark.llm.exact_dedup import without_duplicates
from tidemark.llm.language_id import fit, identify
from tidemark.llm.mixing import mixed
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.pieces import encode_decode


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter stay, all others go. Neither the predicted language nor its score rejects a document.

    Where no language could be learned every document is ``und``, and those with a letter stay by the same rule.
    """
    model = fit(docs, F.lit(True))
    if not model.languages:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    return identify(docs, model, "__lang", "__sure").filter(F.col("__lang") != "und").drop("__lang", "__sure")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return without_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (shingles of five words, similarity 0.8) the document with the smallest doc_id stays."""
    stay = near_duplicates(docs, width=5).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them."""
    return encode_decode(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: SQL cannot express the learned, the randomised and the tokenising stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
