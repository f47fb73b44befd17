"""Splits, scaling, folds and the quality gate around a training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bins per pass and the size below which the k-th smallest id is found by sorting.
BINS = 1024
SORT_ROWS = 100_000


def kth_smallest(df: DataFrame, id_col: str, k: int) -> int | None:
    """The ``k``-th smallest value (from 1) of an integer column; repeats count.

    Each pass counts ids in equal bins and narrows to the bin that holds the ``k``-th, so no task ever sorts the
    table; ids alone are read. The driver sees only bin counts.
    """
    ids = df.select(F.col(id_col).cast("bigint").alias("id"))
    bounds = ids.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("id").alias("n")).first()
    lo, hi, n = bounds["lo"], bounds["hi"], bounds["n"]
    if not 1 <= k <= n:
        return None
    while n > SORT_ROWS and lo < hi:
        width = (hi - lo) // BINS + 1
        inside = ids.filter(F.col("id").between(lo, hi))
        bins = (
            inside.groupBy(F.expr(f"(id - {lo}) div {width}").alias("bin"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        for row in sorted(bins, key=lambda r: r["bin"]):
            if k <= row["n"]:
                lo, n = lo + row["bin"] * width, row["n"]
                hi = min(hi, lo + width - 1)
                break
            k -= row["n"]
    if lo == hi:
        return lo
    inside = ids.filter(F.col("id").between(lo, hi))
    return inside.orderBy("id").limit(k).agg(F.max("id").alias("id")).first()["id"]


def split_positional(df: DataFrame, id_col: str, share: float = 0.8) -> DataFrame:
    """Add ``split``: the first ``floor(share · n)`` rows by a unique integer id are train, the rest test.

    Only ids are examined; the rows themselves are labelled where they lie.
    """
    cut = kth_smallest(df, id_col, int(df.count() * share))
    train = F.lit(False) if cut is None else F.col(id_col) <= cut
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def hash_bucket(id_col: str, buckets: int) -> Column:
    """A bucket that depends on the id alone and can be recomputed by any engine with MD5."""
    prefix = F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8)
    return (F.conv(prefix, 16, 10).cast("bigint") % buckets).cast("int")


def split_random(df: DataFrame, id_col: str, train_percent: int = 80) -> DataFrame:
    """Add ``split``, train or validation, by a hash of the id: the same on every run."""
    train = hash_bucket(id_col, 100) < train_percent
    return df.withColumn("split", F.when(train, "train").otherwise("validation"))


def kfold(df: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    """Add ``fold`` in 0..k-1 by a hash of the id."""
    return df.withColumn("fold", hash_bucket(id_col, k))


def standardize(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Z-scores with mean and population deviation of ``fit_on`` (default ``df``); a constant column gives 0."""
    stats = (df if fit_on is None else fit_on).agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in features],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in features],
        )
    ).scalar()

    def scaled(c: str) -> Column:
        std = stats[f"{c}_std"]
        return (F.col(c) - stats[f"{c}_mean"]) / F.when(std == 0, 1.0).otherwise(std)

    return df.withColumns({c: scaled(c) for c in features})


def error_gate(df: DataFrame, label: str, prediction: str, max_error: float = 0.10) -> DataFrame:
    """One row ``(total, wrong, error, passed)``; passed means error below ``max_error``."""
    wrong = (F.col(label) != F.col(prediction)).cast("bigint")
    return df.agg(F.count("*").alias("total"), F.sum(wrong).alias("wrong")).select(
        "total",
        "wrong",
        (F.col("wrong") / F.col("total")).alias("error"),
        (F.col("wrong") / F.col("total") < max_error).alias("passed"),
    )
