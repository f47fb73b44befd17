"""Near-duplicates by HyperMinHash sketches.

A document is the set of its distinct word shingles. The hashes of a set fall into buckets by their first bits; a
bucket keeps, of its smallest hash, the number of leading zeros and the mantissa bits that follow. Runs of these
registers are banded: documents that agree in one band meet. Candidates are held to a Jaccard estimate, corrected
for registers that agree by chance, and then compared on their full sets.

Equal sets are folded first. Every band bucket has a pivot, its member of the smallest hashed id; all buckets of a pivot make
one group, so each candidate pair meets in some group and a document is in few. A group is cut into blocks of bounded
size and compared block by block; a task gives only the links it needs to connect its members, never all pairs. A
group of ``g`` different sets costs ``g² / 2`` comparisons of registers, spread over its pairs of blocks.

Cases: null texts are empty, and documents without words link with nothing; fewer words than a shingle make one
shingle. Repeated rows come out as often as they went in; rows that share an id are one document in links. Rows without an id are
never the one that stays, unless no row with an id has their set. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.components import connected
from nearkin.llm.words import SHINGLE, byte_texts, map_batches, mix, shingle_hashes, space_words
from nearkin.session import materialize

BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
REST = 64 - BUCKET_BITS
# Six bits hold the leading zeros of a bucket's hash; a register is 16 bits.
MANTISSA = 10
# Chance that a pair right at the threshold shares no band.
MISS = 1e-4
# Documents and shingles of a block.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 1 << 20
SIGMAS = 5


def bit_length(values: np.ndarray) -> np.ndarray:
    high = values >> np.uint64(32)
    low = values & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.frexp(low.astype(float))[1])


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted distinct hashes; 0 stands for an empty bucket."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    starts = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(REST)
    first = np.searchsorted(hashes, starts)
    there = first < np.append(first[1:], len(hashes))
    low = hashes[np.minimum(first, len(hashes) - 1)] & np.uint64((1 << REST) - 1)
    zeros = REST - bit_length(low)
    after = (low << (zeros + 1).astype(np.uint64)) & np.uint64((1 << REST) - 1)
    value = ((zeros + 1).astype(np.uint64) << np.uint64(MANTISSA)) | (after >> np.uint64(REST - MANTISSA))
    return np.where(there, value, 0).astype(np.uint16)


def band_rows(threshold: float) -> int:
    """The longest bands that miss a pair at the threshold with a chance of ``MISS`` at most."""
    fits = [r for r in range(1, REGISTERS) if (1 - threshold**r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A key per band that holds something."""
    bands = values[: len(values) // rows * rows].reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix(key ^ bands[:, i])
    return key[bands.any(axis=1)].view(np.int64)


def estimate(one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one sketch with many, and how many buckets each rests on.

    Two buckets whose smallest hashes differ still agree if leading zeros and mantissa are equal: a cell at ``x`` is
    about ``0.72 x / 2^mantissa`` wide, which gives the chance of it.
    """
    agree = ((many == one) & (one > 0)).sum(axis=1)
    used = np.maximum(((many > 0) | (one > 0)).sum(axis=1), 1)
    chance = 0.72 * 2.0**-MANTISSA * n_one * n_many / np.maximum(n_one + n_many, 1) ** 2.0
    return (agree / used - chance) / (1 - chance), used


def distinct_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(space_words(text), shingle))


def sketches(df: DataFrame, id_col: str, text: str, threshold: float, shingle: int = SHINGLE) -> DataFrame:
    """``(id, body, n_shingles, digest, bands)`` of each row; the digest stands for the set, ``body`` for the text."""
    rows = band_rows(threshold)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, bands = [], [], []
        for value in byte_texts(batch.column(2)):
            hashes = distinct_hashes(value, shingle)
            sizes.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            bands.append(band_keys(registers(hashes), rows) if len(hashes) else ())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "body", "n_shingles", "digest", "bands"],
        )

    columns = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    return map_batches(columns, run, "id bigint, body bigint, n_shingles bigint, digest binary, bands array<bigint>")


def linked(ids: list, sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> list[tuple]:
    """Links that connect what is connected among the documents: within all, or between the two sides only."""
    threshold = percent / 100
    sketch = np.stack([registers(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    known: dict = {}
    for i, doc in enumerate(ids):
        root[i] = known.setdefault(doc, i)
    out = []
    for i in range(len(ids) - 1):
        value, used = estimate(sketch[i], sizes[i], sketch[i + 1 :], sizes[i + 1 :])
        slack = SIGMAS * np.sqrt(threshold * (1 - threshold) / used) + 1 / used
        near = value >= threshold - slack
        near &= 100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :])
        if side is not None:
            near &= side[i + 1 :] != side[i]
        for j in np.flatnonzero(near) + i + 1:
            a, b = find(i), find(j)
            if a == b:
                continue
            place = np.minimum(np.searchsorted(sets[j], sets[i]), sizes[j] - 1)
            both = int((sets[j][place] == sets[i]).sum())
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
    return out


def links(df: DataFrame, reps: DataFrame, id_col: str, text: str, percent: int, shingle: int) -> DataFrame:
    """``(a, b)``: links of digests that connect near-duplicates among ``reps(digest, rep, body, n_shingles, bands)``.

    The row of the id ``rep`` and the text ``body`` gives the set of a digest.
    """
    entries = reps.select(F.explode("bands").alias("key"), "digest", "n_shingles")
    pivots = entries.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("digest").alias("h"), "digest")).alias("pivot"), F.count("*").alias("n")
    )
    pivots = pivots.filter("n > 1").select("key", F.col("pivot.digest").alias("pivot"))
    members = materialize(entries.join(pivots, "key").select("pivot", "digest", "n_shingles").distinct(), "members")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES)).cast("int")
    # A table of its own, so that Spark broadcasts it by its true size or splits the members of a large group.
    groups = materialize(
        members.groupBy("pivot")
        .agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
        .filter("n > 1")
        .select("pivot", blocks.alias("blocks")),
        "groups",
    )
    placed = members.join(groups, "pivot").select(
        "pivot", "digest", "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block")
    )
    wanted = reps.select("digest", "rep", "body").join(placed.select("digest").distinct(), "digest", "left_semi")
    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    texts = texts.join(wanted, ["rep", "body"]).groupBy("digest").agg(F.min("text").alias("text"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    keyed = placed.join(texts, "digest").select("pivot", "digest", "text", "block", other).select(
        "pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "digest", "text"
    )

    def run(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        ids, sides = table["digest"].to_pylist(), table["block"].to_numpy()
        sets = [distinct_hashes(t.as_py(), shingle) for t in table["text"].cast(pa.large_binary())]
        found = linked(ids, sets, sides if lo != hi else None, percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return keyed.groupBy("pivot", "lo", "hi").applyInArrow(run, "a binary, b binary")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 80, shingle: int = SHINGLE
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row.

    Documents are linked when ``100 * |A ∩ B| >= percent * |A ∪ B|``; ``component_id`` is the smallest id reachable
    over links and ``kept`` marks the document of that id.
    """
    sketch = materialize(sketches(df, id_col, text, percent / 100, shingle), "sketches")
    reps = materialize(
        sketch.filter("n_shingles > 0 AND id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min(F.struct("id", "body")).alias("row"), F.max("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
        .select("digest", "row.id", "row.body", "n_shingles", "bands")
        .withColumnRenamed("id", "rep"),
        "sets",
    )
    named = reps.select("digest", "rep")
    found = links(df, reps, id_col, text, percent, shingle)
    found = found.join(named.select(F.col("digest").alias("a"), F.col("rep").alias("u")), "a")
    found = found.join(named.select(F.col("digest").alias("b"), F.col("rep").alias("v")), "b")
    # An id of several texts links all of their sets.
    several = (
        sketch.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("id")
        .agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("id")
    )
    shared = sketch.filter("n_shingles > 0").join(several, "id").join(named, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected(found.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(shared))
    classes = reps.join(component, F.col("rep") == F.col("id"), "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    chosen = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return sketch.join(classes, "digest", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        chosen.alias("component_id"),
        F.coalesce(F.col("id") == chosen, chosen.isNull()).alias("kept"),
    )
