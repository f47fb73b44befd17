"""Requests scored as they arrive, new tickets added to the catalog, votes counted by day.

Sinks write each micro-batch into a folder named by the query and the number of the batch, and replace that folder when a
batch is retried. A query with a new checkpoint counts from 0 again but has a new name, so it adds to what is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from nearkin.operators import tokens, weights
from nearkin.plans.model import SimilarityModel
from nearkin.session import materialize
from nearkin.sources import snapshots


def stream_files(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options
) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType | str, **options) -> DataFrame:
    """A stream of the Parquet table ``name.parquet`` in a folder, which may be one file or a folder of files."""
    # A pattern: Spark takes a path without one for a folder. A file name filter finds no files within a folder of that name.
    return stream_files(spark, f"{folder.rstrip('/')}/{{{name}.parquet}}", schema, **options)


def parse_requests(df: DataFrame, body: str = "body", field: str = "data") -> DataFrame:
    """Add ``text``, the named field of a JSON body, and ``ok``. A malformed body gives null and not ok."""
    # from_json yields a struct of nulls for malformed input in its default mode.
    text = F.from_json(F.col(body), f"`{field}` string")[field]
    return df.withColumn("text", text).withColumn("ok", F.col("text").isNotNull())


AVAILABLE_NOW = {"availableNow": True}
RUN, BATCH = "run_id", "batch_id"


def _run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query of a checkpoint; it lasts as long as the checkpoint does."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def _write_batch(df: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{RUN}={run_id}/{BATCH}={batch_id}")


def stream_score(
    requests: DataFrame,
    model: SimilarityModel,
    out: str,
    checkpoint: str,
    n_best: int | None = None,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Score each arriving ``(query_id, text)`` against the catalog, which stays as it is.

    The ranking window runs per micro-batch against the stored model, whose vectors are read only in the buckets of
    the batch's terms. A batch is read from its source once. ``trigger`` is that of the writer, as in
    ``{"processingTime": "10 seconds"}``.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            _write_batch(model.predict(batch, n_best), out, _run_id(batch.sparkSession, checkpoint), batch_id)
        finally:
            batch.unpersist()

    return (
        requests.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    if snapshots.read_or_none(spark, path) is None:
        return spark.createDataFrame([], schema).withColumns({RUN: F.lit(""), BATCH: F.lit(0)})
    return spark.read.option("basePath", path).parquet(path)


def catalog_append(
    docs: DataFrame,
    catalog: str,
    checkpoint: str,
    id_col: str = "doc_id",
    order_by: str | None = None,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Add arriving ``(id, text)`` rows with their term counts, as a folder per batch.

    Without ``order_by`` a known id is left as it is, and of several new rows with one id the first text in order is
    kept. With it, a row of a known id is a new version; the one of the greatest ``order_by``, then of the first text, counts
    (``catalog_docs``). Known ids are found in the stored catalog instead of stream state, so state does not grow.
    ``catalog`` gets the tables ``docs`` and ``counts``, and ``freq``, by how much the batch changes document frequencies.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = _run_id(spark, checkpoint)
        if order_by is None:
            new = batch.groupBy(id_col).agg(F.min("text").alias("text"))
            known = _stored(spark, f"{catalog}/docs", batch.select(id_col, "text").schema)
            known = known.filter((F.col(RUN) != run_id) | (F.col(BATCH) != batch_id)).select(id_col)
            # The few new ids are met first, so that of the catalog's ids only theirs are shuffled on.
            new = materialize(new, "arrived")
            new = new.join(known.join(new.select(id_col), id_col, "left_semi"), id_col, "left_anti")
        else:
            new = batch.groupBy(id_col, order_by).agg(F.min("text").alias("text"))
        _write_batch(new, f"{catalog}/docs", run_id, batch_id)
        added = spark.read.parquet(f"{catalog}/docs/{RUN}={run_id}/{BATCH}={batch_id}")
        counts = tokens.analyze(_latest(added, id_col, order_by), id_col=id_col)
        _write_batch(counts, f"{catalog}/counts", run_id, batch_id)
        counts = spark.read.parquet(f"{catalog}/counts/{RUN}={run_id}/{BATCH}={batch_id}")
        if order_by is not None:
            added, counts, gone, gone_counts = _replaced(spark, catalog, added, counts, id_col, order_by, run_id, batch_id)
        change = _frequencies(added, counts, 1)
        if order_by is not None:
            change = change.unionByName(_frequencies(gone, gone_counts, -1))
        _write_batch(_summed(change), f"{catalog}/{FREQ}", run_id, batch_id)

    return docs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _latest(docs: DataFrame, id_col: str, order_by: str | None) -> DataFrame:
    if order_by is None:
        return docs
    top = docs.groupBy(id_col).agg(F.max(order_by).alias("_top"))
    tied = docs.join(top, id_col).filter(F.col(order_by).eqNullSafe(F.col("_top")))
    others = [c for c in docs.columns if c not in (id_col, "text")]
    return tied.groupBy(id_col).agg(F.min(F.struct("text", *others)).alias("_row")).select(id_col, "_row.*")


FREQ = "freq"
# Changes of so many batches are merged, and so many merged tables into one.
MERGE_EVERY = 16


def _frequencies(docs: DataFrame, counts: DataFrame, sign: int) -> DataFrame:
    """``(term, df)`` of these documents, and their number under the null term."""
    terms = counts.groupBy("term").agg((F.count("*") * sign).alias("df"))
    return terms.unionByName(docs.agg((F.count("*") * sign).alias("df")).select(F.lit(None).cast("string").alias("term"), "df"))


def _summed(change: DataFrame) -> DataFrame:
    return change.groupBy("term").agg(F.sum("df").alias("df")).filter(F.col("df") != 0)


def _replaced(
    spark: SparkSession, catalog: str, added: DataFrame, counts: DataFrame, id_col: str, order_by: str, run_id: str, batch_id: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The new rows that become current with their counts, and the rows they replace with theirs.

    Of what is stored, only rows of the batch's ids are met.
    """
    columns = [id_col, order_by, "text", RUN, BATCH]
    ids = added.select(id_col).distinct()
    mine = (F.col(RUN) == run_id) & (F.col(BATCH) == batch_id)
    stored = _stored(spark, f"{catalog}/docs", added.select(id_col, order_by, "text").schema)
    before = materialize(_latest(stored.filter(~mine).join(ids, id_col, "left_semi").select(columns), id_col, order_by), "before")
    own = _latest(added, id_col, order_by).withColumns({RUN: F.lit(run_id), BATCH: F.lit(batch_id).cast(before.schema[BATCH].dataType)})
    now = _latest(own.select(columns).unionByName(before.select(columns)), id_col, order_by)
    current = materialize(now.filter(mine).select(id_col), "current")
    gone = materialize(before.join(current, id_col, "left_semi").select(id_col, RUN, BATCH), "gone")
    old = _stored(spark, f"{catalog}/counts", counts.schema).join(gone, [id_col, RUN, BATCH], "left_semi")
    return current, counts.join(current, id_col, "left_semi"), gone, old.select(id_col, "term")


def _changes(spark: SparkSession, catalog: str) -> tuple[Row | None, DataFrame | None]:
    """The merged frequencies, and the changes of batches that aren't in them."""
    merged = snapshots.current(spark, f"{catalog}/{FREQ}_merged")
    if snapshots.read_or_none(spark, f"{catalog}/{FREQ}") is None:
        return merged, None
    fresh = spark.read.option("basePath", f"{catalog}/{FREQ}").parquet(f"{catalog}/{FREQ}")
    if merged is not None:
        fresh = fresh.join(F.broadcast(spark.read.parquet(merged["files"])), [RUN, BATCH], "left_anti")
    return merged, fresh


def compact_vocab(spark: SparkSession, catalog: str, every: int = MERGE_EVERY) -> bool:
    """Merge the frequency changes of batches once there are ``every``, and the merged tables once there are as many.

    A table of frequencies is thus written over again only every ``every`` merges. Readers see the merged table once it is complete.
    Don't run it beside another merge; batches may arrive meanwhile. Says whether it merged.
    """
    merged, fresh = _changes(spark, catalog)
    if fresh is None:
        return False
    # Which batches there are is told by their folders; a batch is merged as it stands now.
    batches = materialize(fresh.select(RUN, BATCH).distinct(), "batches")
    if batches.count() < every:
        return False
    base = f"{catalog}/{FREQ}_merged"
    folders = list(merged["folders"]) if merged else []
    table = fresh.join(F.broadcast(batches), [RUN, BATCH], "left_semi").select("term", "df")
    if len(folders) + 1 >= every:
        table, folders = table.unionByName(spark.read.parquet(*folders)), []
    folder, files = f"{base}/{snapshots.new_folder()}", f"{base}/{snapshots.new_folder('files')}"
    _summed(table).write.parquet(folder)
    done = batches.unionByName(spark.read.parquet(merged["files"])) if merged else batches
    done.coalesce(1).write.parquet(files)
    snapshots.publish(spark, base, [*folders, folder], files)
    return True


def catalog_docs(spark: SparkSession, catalog: str, id_col: str = "doc_id", order_by: str | None = None) -> DataFrame:
    """The current ``(id, text, …)`` of each id of a catalog, with the run and batch it came in."""
    return _latest(spark.read.parquet(f"{catalog}/docs"), id_col, order_by)


def catalog_counts(spark: SparkSession, catalog: str, id_col: str = "doc_id", order_by: str | None = None) -> DataFrame:
    """``(id, term, tf)`` of the current text of each id."""
    counts = spark.read.parquet(f"{catalog}/counts")
    if order_by is not None:
        current = catalog_docs(spark, catalog, id_col, order_by).select(id_col, RUN, BATCH)
        counts = counts.join(current, [id_col, RUN, BATCH], "left_semi")
    return counts.select(id_col, "term", "tf")


def refresh_vocab(spark: SparkSession, catalog: str) -> DataFrame:
    """``(term, df, idf)`` over everything in the catalog, from the changes that batches made; no counts are read."""
    merged, fresh = _changes(spark, catalog)
    parts = [fresh.select("term", "df")] if fresh is not None else []
    parts += [spark.read.parquet(*merged["folders"])] if merged else []
    freq = materialize(_summed(reduce(DataFrame.unionByName, parts)), "freq")
    n = freq.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0))).scalar()
    return weights.idf(freq.filter("term IS NOT NULL"), n)


def catalog_model(
    spark: SparkSession, catalog: str, labels: DataFrame, id_col: str = "doc_id", order_by: str | None = None, n_best: int = 10
) -> SimilarityModel:
    """A model that searches the catalog as it stands, with label columns from ``labels(id, …)``.

    The stored counts are used as they are; only vocabulary and weights are computed. Catalogs hold the plain analyzer's counts.
    """
    counts = materialize(catalog_counts(spark, catalog, id_col, order_by).withColumnRenamed(id_col, "doc_id"), "counts")
    vocab = materialize(refresh_vocab(spark, catalog), "vocab")
    labels = labels.withColumnRenamed(id_col, "doc_id")
    return SimilarityModel(
        vocab=vocab,
        vectors=weights.weigh(counts, vocab),
        labels=labels,
        mode="none",
        n_best=n_best,
        label_names=tuple(c for c in labels.columns if c != "doc_id"),
        counts=counts,
    )


def feedback_counts(
    events: DataFrame, ts: str, key: str, value: Column, window: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Votes per window and key. Works on a stream, where rows later than ``late`` are dropped, and on a table."""
    return (
        events.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", window), key)
        .agg(F.count("*").alias("votes"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "votes", "total")
    )


def run_updates(df: DataFrame, out: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Write each batch's changed windows, open ones included, into the folder of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, out, _run_id(batch.sparkSession, checkpoint), batch_id)

    return (
        df.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def latest_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the last batch of its run. Runs count their own input: several add up by key."""
    values = [c for c in updates.columns if c not in (*keys, RUN, BATCH)]
    last = updates.groupBy(*keys, RUN).agg(F.max_by(F.struct(*values), BATCH).alias("_row"))
    return last.groupBy(*keys).agg(*(F.sum(f"_row.{c}").alias(c) for c in values))


WINDOW = ["window_start", "window_end"]


def count_votes(
    events: DataFrame,
    ts: str,
    key: str,
    value: Column,
    out: str,
    checkpoint: str,
    window: str = "1 day",
    late: str = "1 hour",
    add: bool = False,
    trigger: dict = AVAILABLE_NOW,
) -> StreamingQuery:
    """Count votes per window and key, those of closed windows apart instead of dropping them.

    A window is closed once it ends ``late`` or more before the greatest time of the batches before. Each batch writes what it
    adds, so no state is held and a retried batch replaces what it wrote: ``out`` gets the tables ``votes``, with the column
    ``late``, and ``marks``, the greatest time of each batch. Rows without a time are left out. A query with a new checkpoint would count its
    input again, so it ends in an error where ``out`` holds another query's votes, unless ``add`` says that it brings new ones.
    """
    seconds = F.expr(f"INTERVAL {late}")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run_id = _run_id(spark, checkpoint)
        marks = _stored(spark, f"{out}/marks", StructType().add("last", "timestamp"))
        if not add and not marks.filter(F.col(RUN) != run_id).isEmpty():
            raise ValueError(f"{out} holds the votes of another query")
        before = marks.filter((F.col(RUN) == run_id) & (F.col(BATCH) < batch_id))
        closed = before.agg((F.max("last") - seconds).alias("closed")).first()["closed"]
        rows = batch.select(F.col(ts).cast("timestamp").alias("_ts"), key, value.alias("_value"))
        counts = (
            rows.groupBy(F.window("_ts", window), key)
            .agg(F.count("*").alias("votes"), F.sum("_value").alias("total"), F.max("_ts").alias("last"))
            .withColumn("late", F.lit(False) if closed is None else F.col("window.end") <= F.lit(closed))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "late", "votes", "total", "last")
        )
        _write_batch(counts, f"{out}/votes", run_id, batch_id)
        mine = spark.read.schema(counts.schema).parquet(f"{out}/votes/{RUN}={run_id}/{BATCH}={batch_id}")
        # The mark comes last: a batch that has one is whole.
        _write_batch(mine.agg(F.max("last").alias("last")).coalesce(1), f"{out}/marks", run_id, batch_id)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def votes(spark: SparkSession, out: str, key: str, late: bool | None = None) -> DataFrame:
    """``(window_start, window_end, key, votes, total)`` of the votes in time, of the late ones, or with None of both."""
    parts = spark.read.option("basePath", f"{out}/votes").parquet(f"{out}/votes")
    whole = spark.read.option("basePath", f"{out}/marks").parquet(f"{out}/marks").select(RUN, BATCH)
    parts = parts.join(whole, [RUN, BATCH], "left_semi")
    parts = parts if late is None else parts.filter(F.col("late") == late)
    return parts.groupBy(*WINDOW, key).agg(F.sum("votes").alias("votes"), F.sum("total").alias("total"))
