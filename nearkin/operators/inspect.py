"""Why a document matches: its heaviest terms, and the weight of each query word in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.operators.search import DECIMALS


def inspect_doc(vectors: DataFrame, n_top: int = 10, id_col: str = "doc_id") -> DataFrame:
    """The ``n_top`` heaviest terms of every document; equal weights in term order."""
    order = Window.partitionBy(id_col).orderBy(F.desc("weight"), "term")
    return (
        vectors.select(id_col, "term", F.round("w", DECIMALS).alias("weight"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n_top)
    )


def get_weights(words: DataFrame, vectors: DataFrame, vocab: DataFrame, small: bool) -> DataFrame:
    """The weight of each query word in the paired document, in word order, repeats kept.

    ``words(query_id, doc_id, pos, term)`` has one row per word. A word the document lacks weighs 0, one outside
    the vocabulary is null. ``small`` states that the texts of the words passed ``is_small``.
    """
    keys = words.select("doc_id", "term").distinct()
    terms = words.select("term").distinct()
    if small:
        keys, terms = F.broadcast(keys), F.broadcast(terms)
    held = vectors.join(keys, ["doc_id", "term"], "left_semi").select("doc_id", "term", "w")
    known = vocab.join(terms, "term", "left_semi").select("term", F.lit(0.0).alias("zero"))
    return (
        words.join(known, "term", "left")
        .join(held, ["doc_id", "term"], "left")
        .select("query_id", "doc_id", "pos", "term", F.coalesce("w", "zero").alias("weight"))
    )
