"""TF-IDF weights as long tables: vocabulary ``(term, df, idf)``, vectors ``(id, term, tf, df, w)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.functions import text as T
from nearkin.operators.features import kth_smallest
from nearkin.operators.tokens import VOCAB_ROWS, term_bucket, token_rows
from nearkin.session import materialize


# Stored postings per bucket folder and per file in it, and the most of each a table gets.
POSTINGS_PER_BUCKET = 4_000_000
POSTINGS_PER_FILE = 500_000
MAX_BUCKETS = 4096
MAX_FILES = 4096
# Postings that are laid out at once; more would only add to the disk that the exchange needs.
POSTINGS_PER_ROUND = 200_000_000


def bucket_count(postings: int) -> int:
    return min(MAX_BUCKETS, max(1, math.ceil(postings / POSTINGS_PER_BUCKET)))


def files_per_bucket(rows: int, buckets: int) -> int:
    return min(MAX_FILES, max(1, math.ceil(rows / buckets / POSTINGS_PER_FILE)))


def corpus_size(docs: DataFrame) -> Column:
    """Number of documents, empty ones included, as a scalar subquery."""
    return docs.agg(F.count("*")).scalar()


def doc_freq(counts: DataFrame) -> DataFrame:
    """Documents per term. Partial counts are combined before the shuffle, so common terms do no harm."""
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def idf(freq: DataFrame, n: Column | int, plus_one: bool = True) -> DataFrame:
    """``ln((1+N)/(1+df))``, plus one on the main path. The hosted flow's variant has no ``+1``."""
    n = n if isinstance(n, Column) else F.lit(n)
    value = F.log((1 + n) / (1 + F.col("df")))
    return freq.withColumn("idf", value + 1 if plus_one else value)


def weigh(
    counts: DataFrame,
    vocab: DataFrame,
    id_col: str = "doc_id",
    small: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Unit-length TF-IDF vectors; terms outside the vocabulary are ignored, also in the norm.

    ``small`` states that the counts come from texts that passed ``is_small``: they are broadcast to the vocabulary,
    of which only their folders are read when it is stored in ``buckets``. Other counts should be a table, as should
    the vocabulary: then Spark knows their sizes and splits a common term.
    """
    columns, on = ["term", "df", "idf"], ["term"]
    if buckets:
        columns, on = ["bucket", *columns], ["bucket", "term"]
        counts = counts.withColumn("bucket", term_bucket(F.col("term"), buckets))
    raw = vocab.select(*columns).join(F.broadcast(counts) if small else counts, on).withColumn(
        "raw", F.col("tf") * F.col("idf")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", "tf", "df", (F.col("raw") / norm).alias("w"))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Exact number of terms and a sketch of it for monitoring, in one pass."""
    return vocab.agg(
        F.count("*").alias("terms"), F.approx_count_distinct("term").alias("terms_approx")
    )


def count_vectorize(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    min_tf: int = 1,
    min_df: int = 1,
    max_df: float = 0.999,
    vocab_size: int = VOCAB_ROWS,
    binary: bool = False,
) -> DataFrame:
    """Counts ``(id, term, tf)`` over white space tokens with the flow's bounds on the vocabulary.

    ``max_df`` is a share of documents. The vocabulary keeps the most frequent terms, ties by term; ``vocab_size``
    bounds it, so it is broadcast.
    """
    counts = materialize(
        token_rows(docs, text, T.tokens_standard, id_col)
        .withColumnRenamed("token", "term")
        .groupBy(id_col, "term")
        .agg(F.count("*").alias("tf")),
        "counts",
    )
    terms = materialize(
        counts.groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        .filter((F.col("df") >= min_df) & (F.col("df") <= F.floor(corpus_size(docs) * max_df))),
        "terms",
    )
    # Terms below the frequency of the last one that fits never reach the sort.
    beyond = terms.count() - vocab_size
    if beyond > 0:
        terms = terms.filter(F.col("cf") >= kth_smallest(terms, "cf", beyond + 1))
    kept = terms.orderBy(F.desc("cf"), "term").limit(vocab_size).select("term")
    counts = counts.filter(F.col("tf") >= min_tf).join(F.broadcast(kept), "term", "left_semi")
    tf = F.lit(1.0) if binary else F.col("tf").cast("double")
    return counts.select(id_col, "term", tf.alias("tf"))


def idf_min_df(counts: DataFrame, n: Column | int, min_df: int = 5) -> DataFrame:
    """``(id, term, tf, w)`` with the flow's IDF; terms in fewer than ``min_df`` documents weigh 0.

    The vocabulary of ``count_vectorize`` is bounded; one of other counts is broadcast only within that bound.
    """
    vocab = materialize(idf(doc_freq(counts), n, plus_one=False), "vocab")
    weight = F.when(F.col("df") >= min_df, F.col("tf") * F.col("idf")).otherwise(0.0)
    vocab = F.broadcast(vocab) if vocab.count() <= VOCAB_ROWS else vocab
    return counts.join(vocab, "term").select(*counts.columns, weight.alias("w"))
