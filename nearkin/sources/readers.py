"""Scans. All are lazy reads with column pruning and filter pushdown left to Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearkin.operators.features import kth_smallest
from nearkin.operators.tables import concat_rows
from nearkin.sources import snapshots


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None, multi_line: bool = True, **options
) -> DataFrame:
    """CSV with a header whose quoted fields may hold commas, quotes and newlines.

    An empty field is null and ``""`` an empty text; the null marker is a character no text holds. A file whose fields
    may hold newlines is read by one task; without ``multi_line`` Spark splits large files.
    """
    reader = spark.read.options(
        header=True, multiLine=multi_line, escape='"', nullValue="\0", inferSchema=schema is None,
        timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    ).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path if isinstance(path, str) else list(path))


def scan_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several Parquet paths as one scan; Spark reads their files in parallel."""
    return spark.read.parquet(*paths)


def scan_prefix(spark: SparkSession, prefix: str, glob: str = "*.parquet") -> DataFrame:
    """Every Parquet file below ``prefix`` at any depth."""
    return spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob).parquet(prefix)


def _has_files(spark: SparkSession, direc: str, suffix: str) -> bool:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(direc)
    return not files.select("path").limit(1).isEmpty()


def scan_dir(
    spark: SparkSession, direc: str, csv_schema: StructType | str | None = None
) -> DataFrame:
    """All ``.parquet`` and ``.csv`` files of one directory as one table; other files are skipped.

    A column missing on one side is null there. Raises if the directory holds neither kind.
    """
    parts = []
    if _has_files(spark, direc, ".parquet"):
        parts.append(spark.read.option("pathGlobFilter", "*.parquet").parquet(direc))
    if _has_files(spark, direc, ".csv"):
        parts.append(scan_csv(spark, direc, csv_schema, pathGlobFilter="*.csv"))
    if not parts:
        raise ValueError(f"no .parquet or .csv files in {direc}")
    return concat_rows(parts)


def get_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The table kept at ``path``; built with ``build`` first when absent or when ``force`` is set.

    A build that didn't come to its end is no table: it is built again, and an earlier one stays until then.
    """
    found = None if force else snapshots.current(spark, path)
    if found is None:
        folder = f"{path.rstrip('/')}/{snapshots.new_folder()}"
        build().write.parquet(folder)
        snapshots.publish(spark, path, [folder])
        found = snapshots.current(spark, path)
    return spark.read.parquet(*found["folders"])


FILES = ("path", "modificationTime", "length")


def cached_dir(
    spark: SparkSession, path: str, direc: str, csv_schema: StructType | str | None = None, force: bool = False
) -> DataFrame:
    """``scan_dir`` kept at ``path`` with a list of the files it read.

    Files that came since are read and added; the others aren't opened. Where a known file changed or is gone, or with
    ``force``, all are read again. Names and sizes of files pass through the driver, as in any scan.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{parquet,csv}").load(direc).select(*FILES)
    found = None if force else snapshots.current(spark, path)
    folders, fresh = [], listed
    if found is not None:
        known = spark.read.parquet(found["files"])
        if known.join(listed, [*FILES], "left_anti").isEmpty():
            folders, fresh = found["folders"], listed.join(known, [*FILES], "left_anti")
    names = [r["path"] for r in fresh.select("path").collect()]
    if not names and found is None:
        raise ValueError(f"no .parquet or .csv files in {direc}")
    if names:
        parquet, csv = ([n for n in names if n.endswith(end)] for end in (".parquet", ".csv"))
        parts = [spark.read.parquet(*parquet)] if parquet else []
        parts += [scan_csv(spark, csv, csv_schema)] if csv else []
        base = path.rstrip("/")
        folder, files = f"{base}/{snapshots.new_folder()}", f"{base}/{snapshots.new_folder('files')}"
        concat_rows(parts).write.parquet(folder)
        taken = listed.join(F.broadcast(spark.createDataFrame([(n,) for n in names], "path string")), "path", "left_semi")
        taken = taken.unionByName(spark.read.parquet(found["files"])) if folders else taken
        taken.select(*FILES).coalesce(1).write.parquet(files)
        folders = [*folders, folder]
        snapshots.publish(spark, path, folders, files)
    return spark.read.option("mergeSchema", True).parquet(*folders)


def scan_sampled(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    limit: int = 50_000,
    order_by: str | None = None,
    **options,
) -> DataFrame:
    """At most ``limit`` rows of a source, the same rows each time.

    They are the first by ``order_by``, an integer column (null last), or those of the lowest hash of the whole row. Only keys are
    examined to find the last one taken; rows are filtered where they lie. Rows that tie with the last are taken in the
    order of their hash until the limit is reached.
    """
    df = scan_csv(spark, path, **options) if fmt == "csv" else spark.read.format(fmt).load(path, **options)
    # Without the lowest bits differences of hashes stay within a long.
    hashed = F.shiftrightunsigned(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns]), 2)
    keyed = df.withColumn("_key", hashed if order_by is None else F.coalesce(F.col(order_by).cast("long"), F.lit(2**62)))
    last = kth_smallest(keyed, "_key", limit)
    if last is None:
        return df
    below = keyed.filter(F.col("_key") < last)
    tied = keyed.filter(F.col("_key") == last).withColumn("_hash", hashed)
    missing = limit - below.count()
    tied = tied.orderBy("_hash").limit(missing) if tied.count() > missing else tied
    return below.drop("_key").unionByName(tied.drop("_key", "_hash"))
