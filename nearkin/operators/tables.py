"""Projections, filters, casts and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tried in this order; the first type every non-null value fits wins. A value must look like the type before it is
# cast: a failing cast costs far more than a pattern.
CAST_CANDIDATES = {
    "bigint": r"^\s*[+-]?\d+\s*$",
    "double": r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
    "boolean": r"(?i)^\s*(true|false)\s*$",
    "timestamp_ntz": r"^\s*\d{4}-\d{1,2}-\d{1,2}",
}

# The types declared for a ticket table. Nested fields are kept as the text they came in.
TICKET_SCHEMA = {
    "__typename": "string",
    "id": "string",
    "createdAt": "string",
    "updatedAt": "string",
    "url": "string",
    "repository": "string",
    "body": "string",
    "bodyHTML": "string",
    "bodyText": "string",
    "bodyUrl": "string",
    "lastEditedAt": "string",
    "publishedAt": "string",
    "resourcePath": "string",
    "state": "string",
    "title": "string",
    "titleHTML": "string",
    "authorAssociation": "string",
    "databaseId": "bigint",
    "closed": "boolean",
    "closedAt": "string",
    "isPinned": "boolean",
    "locked": "boolean",
    "number": "bigint",
    "author": "string",
    "assignees": "string",
    "participants": "string",
    "reactions": "string",
    "labels": "string",
    "comments": "string",
    "owner": "string",
}


def concat_rows(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column missing on one side is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def concat_dedupe(dfs: Sequence[DataFrame], dedupe: bool = False) -> DataFrame:
    """``concat_rows`` with an optional removal of equal rows."""
    df = concat_rows(dfs)
    return df.dropDuplicates() if dedupe else df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def corpus_labels(df: DataFrame, corpus: str, labels: Sequence[str]) -> DataFrame:
    """Corpus text and its label as a struct whose fields keep their own types."""
    return df.select(F.col(corpus).alias("corpus"), F.struct(*labels).alias("label"))


def query_eq(df: DataFrame, **values) -> DataFrame:
    """Rows where every named column equals its value. Null never matches."""
    if not values:
        raise ValueError("query_eq needs at least one column=value")
    return df.filter(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in values.items()]))


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """A type per string column, from one aggregate over the whole table."""
    columns = list(columns or [n for n, t in df.dtypes if t == "string"])
    if not columns:
        return {}
    def fits(c: str, t: str) -> Column:
        value = F.when(F.col(c).rlike(CAST_CANDIDATES[t]), F.col(c).try_cast(t).isNotNull()).otherwise(False)
        return F.bool_and(F.when(F.col(c).isNotNull(), value))

    checks = [fits(c, t).alias(f"{i}_{t}") for i, c in enumerate(columns) for t in CAST_CANDIDATES]
    row = df.agg(*checks).first()
    return {
        c: next((t for t in CAST_CANDIDATES if row[f"{i}_{t}"]), "string") for i, c in enumerate(columns)
    }


def cast_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast each named column; a value that does not fit becomes null."""
    return df.select(
        *[F.col(c).try_cast(schema[c]).alias(c) if c in schema else F.col(c) for c in df.columns]
    )


def infer_and_cast(df: DataFrame, schema: dict[str, str] | None = None) -> DataFrame:
    """Cast to ``schema``, or to the types found by ``infer_types``."""
    return cast_columns(df, schema if schema is not None else infer_types(df))


def _outcomes(df: DataFrame, schema: dict[str, str]) -> list[Column]:
    """Per column that is there, the value that its type refuses, or null."""
    return [
        F.when(F.col(c).try_cast(t).isNull() & F.col(c).isNotNull(), F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).cast("string").alias("value")
        ))
        for c, t in schema.items()
        if c in df.columns
    ]


def cast_rejects(df: DataFrame, schema: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """``(keep…, column, type, value)``: a row for each value that ``cast_columns`` turns into null.

    ``keep`` names the columns that tell the rows apart; they come out as they are in ``df``, so none may be called
    ``column``, ``type`` or ``value``. One pass over the columns of the schema; no shuffle. Columns that ``df`` lacks are
    left out, as in ``conform``.
    """
    if clash := {"column", "type", "value"} & set(keep):
        raise ValueError(f"columns of these names can't be kept: {sorted(clash)}")
    outcomes = _outcomes(df, schema)
    if not outcomes:
        outcomes = [F.lit(None).cast("struct<column string, type string, value string>")]
    bad = F.filter(F.array(*outcomes), lambda x: x.isNotNull())
    return df.select(*keep, F.inline(bad))


def conform(df: DataFrame, schema: dict[str, str] = TICKET_SCHEMA) -> DataFrame:
    """Exactly the columns of ``schema``, in its order and types; a missing one is null, others are dropped."""
    return df.select(
        *[(F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()]
    )


def drop_cols(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def label_first(df: DataFrame, label: str) -> DataFrame:
    return df.select(label, *[c for c in df.columns if c != label])


def scale_const(df: DataFrame, column: str, divisor: float = 100_000.0) -> DataFrame:
    return df.withColumn(column, F.col(column) / F.lit(divisor))
