"""A corpus pipeline: toxic documents go, one of each group of near copies stays, benchmark passages go with their
document, secrets are blanked out, and the texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all rows its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm import bpe, leaks, neardup, secrets, toxicity
from nearkin.llm.queries import table
from nearkin.session import materialize

ORACLE_SQL = None
TOXIC_SCORE = 0.7
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.7, under a model fitted on the labelled ones among them."""
    model = toxicity.labelled(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_score").filter(F.col("_score") < TOXIC_SCORE).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, once if its row repeats.

    Rows without an id are documents of their own, after all ids. Documents without words stay.
    """
    ids = docs.agg(F.max("doc_id").cast("long").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("unnamed")).first()
    keyed = docs.withColumn("_id", F.col("doc_id"))
    if ids["unnamed"]:
        after = F.monotonically_increasing_id() + F.lit(max(ids["last"] or 0, 0) + 1).cast("long")
        unnamed = materialize(docs.filter("doc_id IS NULL").withColumn("_id", after), "unnamed")
        keyed = keyed.filter("doc_id IS NOT NULL").unionByName(unnamed)
    found = neardup.near_duplicates(keyed, id_col="_id", percent=NEAR_PERCENT)
    gone = found.filter(~F.col("kept")).select("_id").distinct()
    repeated = found.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select("_id")
    kept = keyed.join(gone, "_id", "left_anti")
    once = kept.join(repeated, "_id", "left_anti")
    return once.unionByName(kept.join(repeated, "_id", "left_semi").dropDuplicates(["_id", "text"])).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item.

    Rows of one id go together; rows without an id are told apart by their text.
    """
    named = F.concat(F.lit("id "), F.col("doc_id").cast("string"))
    keyed = docs.withColumn("_key", F.coalesce(named, F.concat(F.lit("text "), F.sha2("text", 256))))
    found = leaks.find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="_key")
    return keyed.join(found.select("_key").distinct(), "_key", "left_anti").select(*docs.columns)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; the lengths of the changed ones follow."""
    found = secrets.find_secrets(docs).withColumn("_changed", F.size("secrets") > 0)
    clean = secrets.redact(found)
    length = F.when(F.col("_changed"), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_sha256)``; the digest is that of the ids decoded again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    kept = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("ids").alias("coded"))
    return bpe.decode(kept, ranks, ids="coded").select(
        "doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", blank_secrets),
    ("byte_bpe", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
