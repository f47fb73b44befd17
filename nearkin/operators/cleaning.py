"""Cleaning steps that need more than one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import text as T
from nearkin.session import materialize


# Counters of a group; far more than its lines per text divided by the share, so that few rare lines pass by chance.
COUNTERS = 1 << 16


def boilerplate_lines(
    df: DataFrame, text: str, group: str, min_share: float, min_docs: int = 2, counters: int = COUNTERS
) -> DataFrame:
    """``(group, lines)``: lines that stand in at least ``min_share`` of the texts of a group.

    Lines are first counted by a hash, in ``counters`` numbers a group: no line is more frequent than its counter, so only
    lines of counters that reach the share are counted themselves, and the many lines of one text are never shuffled.
    Counts are combined before the shuffle, so neither a large group nor a common line lands in one
    task. A list holds at most (mean lines per text) / ``min_share`` lines.
    """
    lines = df.select(
        group, F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")
    ).filter(F.trim("line") != "")
    lines = lines.withColumn("_counter", F.pmod(F.xxhash64("line"), F.lit(counters)))
    totals = materialize(df.groupBy(group).agg(F.count("*").alias("texts")), "texts")
    often = (F.col("n") >= min_docs) & (F.col("n") >= F.col("texts") * min_share)

    def reached(counts: DataFrame) -> DataFrame:
        return counts.join(totals, group).filter(often)

    likely = reached(lines.groupBy(group, "_counter").agg(F.count("*").alias("n"))).select(group, "_counter")
    lines = lines.join(materialize(likely, "likely"), [group, "_counter"], "left_semi")
    per_line = reached(lines.groupBy(group, "line").agg(F.count("*").alias("n")))
    return per_line.groupBy(group).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    df: DataFrame, text: str, group: str, min_share: float = 0.5, min_docs: int = 2
) -> DataFrame:
    """Drop heading lines and the lines most texts of a group share; the order of the rest is kept.

    The texts are not taken apart: each row meets the short list of its group and is filtered in place. The lists are
    written to a scratch table, so that Spark broadcasts them by their true size or splits a large group.
    """
    repeated = materialize(boilerplate_lines(df, text, group, min_share, min_docs), "lines")
    kept = F.filter(
        F.split(text, "\n"),
        lambda line: ~T.is_heading(line)
        & ~F.coalesce(F.array_contains(F.col("lines"), line), F.lit(False)),
    )
    return (
        df.join(repeated, group, "left")
        .withColumn(text, F.array_join(kept, "\n"))
        .select(*df.columns)
    )


def concat_comments(
    df: DataFrame, id_col: str, order_col: str, text: str, sep: str = "\n\n", chunk: int = 256
) -> DataFrame:
    """One text per id: its parts in order.

    Parts are first joined in chunks of ``chunk`` order values, each in its own group, so a long thread is
    spread over tasks and only its chunks meet at the end.
    """

    def joined(order: str, value: str):
        parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("t"))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), sep)

    chunks = (
        df.withColumn("_chunk", F.floor(F.col(order_col) / chunk))
        .groupBy(id_col, "_chunk")
        .agg(joined(order_col, text).alias("_part"), F.count("*").alias("_n"))
    )
    return chunks.groupBy(id_col).agg(joined("_chunk", "_part").alias(text), F.sum("_n").alias("parts"))


def clean_issue(
    df: DataFrame,
    title: str = "title",
    body: str = "body",
    url: str = "url",
    group: str = "repo",
    min_share: float = 0.5,
) -> DataFrame:
    """Raw tickets to ``(title_body, url, title)``: code, addresses, marks and template text removed."""
    stripped = df.withColumn(body, T.strip_markdown(T.strip_urls(T.strip_code(F.col(body)))))
    kept = drop_boilerplate(stripped, body, group, min_share)
    return kept.select(
        T.title_body(F.col(title), F.col(body)).alias("title_body"),
        F.col(url).alias("url"),
        F.col(title).alias("title"),
    )
