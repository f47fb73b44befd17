"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# A job of that many seconds may have left shuffle files worth a collection of the driver's garbage.
LONG_JOB_S = 5
# The scratch tables written within the innermost `passing`.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def get_session(app: str = "nearkin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; ``conf`` adds or overrides.

    On a cluster the submit command supplies master, memory and ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that cuts lineage or is handed to another job.

    It lies in the folder the session names in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="nearkin-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/nearkin/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and read it back.

    The reader knows the true size of the table, so Catalyst picks joins on facts, and lost executors
    never force the work before the table to be done again. So its shuffle files are of no more use; Spark deletes
    them when the driver has collected the plan, which is brought about after a long job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    began = time.monotonic()
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - began > LONG_JOB_S:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that no one holds any more."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables written within are deleted at the end, but for those handed to the function it gives.

    What is kept lasts as long as the tables of the next ``passing`` around this one, if there is one.
    """
    written, kept = [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    outer = _written.get()
    token = _written.set(written)
    try:
        yield keep
    finally:
        _written.reset(token)
        files = [file for df in kept for file in df.inputFiles()]
        for path in written:
            if not any(f"/{path.rsplit('/', 1)[-1]}/" in file for file in files):
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            elif outer is not None:
                outer.append(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the input is so small that it may come in fewer pieces than there are cores.

    Decided by Spark's estimate of its size, without a job; a large input is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    piece = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * piece else df
