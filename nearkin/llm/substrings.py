"""Substring deduplication with content-defined chunks.

A gear hash rolls over the bytes of a text; where its upper bits are zero, a chunk ends. Cuts depend on the bytes just before
them, so an insertion moves only the chunks around it. Two neighbouring chunks together are a unit with a
64-bit digest. A unit is repeated when documents of two ids hold it; overlapping and adjoining repeated units of a document
make a passage, reported from ``min_chars`` or ``min_words`` on. The document of the smallest id keeps a unit, the others lose it.

Digests are combined per id before their shuffle, so a unit that most documents hold is one row per task; units are joined
back by digest, a join that Spark splits.

Spans count code points, the end exclusive. Null and empty texts have no units. Rows that share an id are one
document; null ids are ignored. A passage that repeats only within one document is left alone. Extra columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.words import byte_texts, map_batches
from nearkin.session import materialize

# Cuts look at WINDOW bytes; on average one byte in 2^CUT_BITS ends a chunk.
WINDOW = 16
CUT_BITS = 4
MIN_CHUNK, MAX_CHUNK = 8, 48
# A passage loses up to some 44 characters at its edges, over 20 short words; either limit is enough.
MIN_CHARS, MIN_WORDS = 150, 24
# A place in a text is one number: the code points before it, and in the low bits the words that start before it.
WORD_BITS = 32

IS_SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
GEAR = (lambda r: np.array([r.getrandbits(32) for _ in range(256)], np.uint32))(random.Random(11))


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of it and the bytes before: each earlier byte's value shifted one further."""
    value, reach = GEAR[data], 1
    while reach < WINDOW:
        older = np.zeros_like(value)
        older[reach:] = value[:-reach] << np.uint32(reach)
        value = value + older
        reach *= 2
    return value


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, in bytes, never within a character."""
    if not len(data):
        return []
    wanted = np.flatnonzero(((rolling(data) >> np.uint32(WINDOW - CUT_BITS)) & np.uint32((1 << CUT_BITS) - 1)) == 0) + 1
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    place = np.searchsorted(starts, wanted)
    wanted = np.append(starts, len(data))[place]
    out, last = [], 0
    for cut in (*wanted.tolist(), len(data)):
        while cut - last > MAX_CHUNK + MIN_CHUNK:
            end = last + MAX_CHUNK
            while data[end] & 0xC0 == 0x80:
                end += 1
            out.append(end)
            last = end
        if cut - last >= MIN_CHUNK or (cut == len(data) and cut > last):
            out.append(cut)
            last = cut
    return out


def units(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends as places and digests of all pairs of neighbouring chunks."""
    data = np.frombuffer(text or b"", np.uint8)
    edges = [0, *cuts(data)]
    if len(edges) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
    spaces = IS_SPACE[data]
    words = np.concatenate([[0], np.cumsum(~spaces & np.concatenate([[True], spaces[:-1]]))])[edges]
    points = points << WORD_BITS | words
    digests = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(edges, edges[2:])]
    return points[:-2], points[2:], np.array(digests, np.uint64).view(np.int64)


def _lists(rows: list[np.ndarray], kind: np.dtype) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows).astype(kind) if rows else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _unit_rows(df: DataFrame, id_col: str, text: str, places: bool) -> DataFrame:
    columns = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [units(t) for t in byte_texts(batch.column(1))]
        if not places:
            lists = [_lists([np.unique(d) for _, _, d in found], np.int64)]
            return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "digests"])
        lists = [_lists([f[i] for f in found], kind) for i, kind in enumerate((np.int64, np.int64, np.int64))]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "starts", "ends", "digests"])

    if not places:
        rows = map_batches(columns, run, "id bigint, digests array<bigint>")
        return rows.select("id", F.explode("digests").alias("digest"))
    rows = map_batches(columns, run, "id bigint, starts array<bigint>, ends array<bigint>, digests array<bigint>")
    return rows.select("id", F.inline(F.arrays_zip("digests", "starts", "ends"))).toDF("id", "digest", "start", "end")


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS
) -> DataFrame:
    """``(id, start, end, removed, first_id)``: passages that stand in other documents as well.

    A passage has at least ``min_chars`` characters or touches at least ``min_words`` words. Where some of its units are kept and some are not, it comes in parts.
    ``removed`` tells whether documents of smaller ids hold the part, unit by unit; ``first_id`` is the smallest of them,
    or the id itself for the document that keeps it.
    """
    shared = materialize(
        _unit_rows(df, id_col, text, places=False)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .filter("first < last")
        .select("digest", "first"),
        "shared_units",
    )
    hits = _unit_rows(df, id_col, text, places=True).join(shared, "digest").groupBy("id", "start", "end").agg(
        F.min("first").alias("first")
    )
    hits = hits.withColumn("removed", F.col("first") < F.col("id"))
    # Read twice below; written once, the join and its exchanges are not done again.
    passages = materialize(_runs(hits, ["id"], "passage"), "passages")
    bounds = passages.groupBy("id", "passage").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    long = bounds.filter((_points("b") - _points("a") >= min_chars) | (_words("b") - _words("a") >= min_words)).select("id", "passage")
    parts = _runs(passages.join(long, ["id", "passage"]), ["id", "passage", "removed"], "part")
    return (
        parts.groupBy("id", "passage", "removed", "part")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first_id"))
        .select(F.col("id").alias(id_col), _points("start").alias("start"), _points("end").alias("end"), "removed", "first_id")
    )


def _points(place: str) -> Column:
    return F.shiftright(place, WORD_BITS)


def _words(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << WORD_BITS) - 1)


def _runs(hits: DataFrame, by: list[str], name: str) -> DataFrame:
    """``hits`` and the number of the run of overlapping or adjoining spans that each lies in; a text's spans are one task's."""
    ordered = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = hits.withColumn("fresh", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.withColumn(name, numbered).drop("fresh")


def remove_passages(df: DataFrame, passages: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the removed passages cut out of ``text``; the passages of one document are few and ride along."""
    spans = passages.filter("removed").groupBy(F.col(id_col).alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans")
    )
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    joined = df.join(spans, F.col(id_col) == F.col("_id"), "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(kept)).select(*df.columns)
