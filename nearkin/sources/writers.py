"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which is all a CSV field can hold."""
    return df.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, ArrayType | MapType | StructType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """CSV parts that ``scan_csv`` reads back unchanged."""
    _flat(df).write.mode(mode).options(
        header=header, escape='"', timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    ).csv(path)


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write by content type; Parquet keeps nested columns."""
    if fmt == "csv":
        write_csv(df, path, mode=mode)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError("fmt must be csv or parquet")


def preview(df: DataFrame, order_by: str | Sequence[str], rows: int = 1000) -> DataFrame:
    """The first chunk of a table in a stated order."""
    return df.orderBy(order_by).limit(rows)


def iterate_chunks(df: DataFrame, rows: int = 1000) -> Iterator[list[Row]]:
    """Walk a table chunk by chunk; one partition at a time is held."""
    chunk: list[Row] = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == rows:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def write_labelled_csv(
    df: DataFrame, path: str, label: str, features: Sequence[str], mode: str = "errorifexists"
) -> None:
    """Label first, then the features, without header."""
    write_csv(df.select(label, *features), path, header=False, mode=mode)


def write_split(df: DataFrame, path: str, split_col: str = "split", mode: str = "errorifexists") -> None:
    """One CSV folder per value of ``split_col``, in a single pass over ``df``."""
    _flat(df).write.mode(mode).options(header=True, escape='"').partitionBy(split_col).csv(path)
