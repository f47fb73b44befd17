"""Versions of a stored table or model: data in folders of its own, named by a row that is written last.

A write that fails leaves the last version as it was, and readers never meet parts of two versions. Older versions stay
readable for those who hold them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

VERSIONS = "versions"
SCHEMA = "version long, folders array<string>, files string"


def read_or_none(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame | None:
    """The table at a path, or None where there is none."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def current(spark: SparkSession, base: str) -> Row | None:
    """``(version, folders, files)`` of the last version that was written to its end; folders are full paths."""
    found = read_or_none(spark, f"{base.rstrip('/')}/{VERSIONS}", SCHEMA, "json")
    row = found.orderBy(F.desc("version"), F.desc("folders")).first() if found is not None else None
    if row is None:
        return None
    at = [f"{base.rstrip('/')}/{folder}" for folder in row["folders"]]
    return Row(version=row["version"], folders=at, files=row["files"] and f"{base.rstrip('/')}/{row['files']}")


def new_folder(name: str = "data") -> str:
    return f"{name}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, base: str, folders: Sequence[str], files: str | None = None) -> None:
    """Make these folders, all written by now, the current version."""
    last = current(spark, base)
    row = (last["version"] + 1 if last else 1, [f.rsplit("/", 1)[-1] for f in folders], files and files.rsplit("/", 1)[-1])
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(f"{base.rstrip('/')}/{VERSIONS}")
