"""Exact duplicates by content-defined chunk recipes, in DataFrame functions alone.

A text is cut where its own content says so: a chunk runs at least ``LEAST`` characters on to the next end of a
sentence or line, ``MOST`` at most. Chunks get an identifier by hash, and the identifier is verified: all distinct
chunks are gathered by it once, and if any two differ under one identifier, the next, wider kind of identifier
is tried and verified in turn. From then on texts are compared as ordered lists of verified
identifiers, a few longs each; no long text moves again.

Nulls and edge cases: a null text counts as empty; empty texts share the empty recipe and so one group. A null
doc_id is never the largest unless all of its group are null. Rows that repeat both doc_id and text are the
same document and carry the same decision. Extra columns of any name go with their rows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, unused

LEAST, MOST = 512, 4096
_CHUNK = rf"(?s).{{{LEAST},{MOST}}}?(?:(?<=[\n.!?])|\z)|.{{1,{MOST}}}"

#: Kinds of identifiers, each wider than the one before.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    F.xxhash64,
    lambda c: F.concat_ws(":", F.xxhash64(c), F.hash(c), F.length(c)),
    lambda c: F.sha2(c, 512),
)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def verified(pieces: DataFrame, kinds: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> Callable[[Column], Column]:
    """The first kind of identifier under which no two distinct values of ``pieces(chunk)`` meet."""
    for kind in kinds:
        named = pieces.select(kind(F.col("chunk")).alias("id"), "chunk").groupBy("id", "chunk").agg(F.lit(1).alias("one"))
        if named.groupBy("id").agg(F.sum("one").alias("n")).filter("n > 1").isEmpty():
            return kind
    raise ValueError("distinct chunks share an identifier of every kind")


def exact_duplicates(docs: DataFrame, kinds: Sequence[Callable[[Column], Column]] = IDENTIFIERS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = verified(source.select(F.explode(chunks(F.col("text"))).alias("chunk")), kinds)
    recipes = source.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), lambda c: kind(c)).alias("recipe"))
    recipes = cut(recipes, "exact-recipes")
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return recipes.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, each once, with all their columns."""
    own, sha = unused(docs, "__id"), unused(docs, "__sha")
    stay = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)).distinct()
    marked = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    hits = marked.join(stay, marked[own].eqNullSafe(stay[own]) & (marked[sha] == stay[sha]), "left_semi")
    return hits.dropDuplicates([own, sha]).select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("n_chunks")


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
