"""Exact top-k search by inner product over integer vectors.

Vectors are packed, as they are read, into packets with one run of values per dimension. A query accumulates its products
with a packet one block of dimensions after another, the block in which it has most mass first. By Cauchy-Schwarz
the product over the blocks left is at most the product of the two remaining norms; candidates that cannot reach the
query's k-th best any more are dropped and the rest are moved together. The k-th best so far is carried from
packet to packet.

Queries are packed likewise, in blocks of bounded size. Each packet meets each query block once: packets are
repeated per query block, query blocks per salt, and both are joined on the two by sorting, so neither side is
broadcast, no task gets more than its share and a query's bests are carried through all packets of a task. A task hands on
the k best per query.

A vector takes part if it and its components are not null and finite, also once scaled. Components become
``floor(scale * x)``. Where values or sums may leave the range of 64 bits, products are made in whole numbers of any size; a score beyond a
long is given as the end of its range. Only vectors of one length are compared. Rows that repeat an id are
candidates each on its own, never of their id's query; as a query an id counts once, with its least vector. Null ids are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.session import materialize

PACKET = 2048
BLOCK_DIMS = 8
LIMIT = float(1 << 31)
LONG = (-(1 << 63), (1 << 63) - 1)
PACKET_SCHEMA = "dims int, wide boolean, ids binary, values binary"


def pack(ids: np.ndarray, vectors: list, scale: float) -> Iterator[dict]:
    """Packets ``(dims, wide, ids, values)`` of the vectors that take part; values lie dimension by dimension.

    Values are 32-bit integers, or whole numbers in doubles in a wide packet of vectors that don't fit.
    """
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and ids[i] is not None:
            by_length.setdefault(len(v), []).append(i)
    for dims, rows in by_length.items():
        matrix = np.array([vectors[i] for i in rows], dtype=float).reshape(len(rows), dims)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(scale * matrix)
        good = np.isfinite(matrix).all(axis=1) & np.isfinite(scaled).all(axis=1)
        named = np.array([ids[i] for i in rows], dtype=np.int64)
        fits = (np.abs(scaled) < LIMIT).all(axis=1)
        for wide, chosen, kind in ((False, good & fits, np.int32), (True, good & ~fits, np.float64)):
            values, kept = scaled[chosen], named[chosen]
            for start in range(0, len(kept), PACKET):
                part = np.ascontiguousarray(values[start : start + PACKET].T.astype(kind))
                yield {"dims": dims, "wide": wide, "ids": kept[start : start + PACKET].tobytes(), "values": part.tobytes()}


def whole_numbers(values: bytes, dims: int, n: int, wide: bool) -> np.ndarray:
    """The values of a packet of ``n`` vectors as 64-bit integers, or as Python's where it is wide."""
    if not wide:
        return np.frombuffer(values, np.int32).reshape(dims, n).astype(np.int64)
    found = np.frombuffer(values, np.float64)
    return np.array([int(v) for v in found], dtype=object).reshape(dims, n)


def _packets(batch: pa.Table | pa.RecordBatch, scale: float) -> list[dict]:
    return list(pack(batch.column(0).to_pylist(), batch.column(1).to_pylist(), scale))


class Candidates:
    """A packet of vectors with the squared mass of each block of dimensions."""

    def __init__(self, dims: int, ids: bytes, values: bytes, wide: bool = False):
        self.ids = np.frombuffer(ids, np.int64)
        self.values = whole_numbers(values, dims, len(self.ids), wide)
        starts = range(0, dims, BLOCK_DIMS)
        self.blocks = [slice(s, min(s + BLOCK_DIMS, dims)) for s in starts]
        self.mass = np.array([(self.values[b].astype(float) ** 2).sum(axis=0) for b in self.blocks], dtype=float).reshape(
            len(self.blocks), len(self.ids)
        )
        self.total = self.mass.sum(axis=0)

    def best(self, query_id: int, query: np.ndarray, k: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The ``k`` best ``(-score, id)`` among ``known`` and this packet."""
        if self._large(query):
            return self._best_of_any_size(query_id, query, k, known)
        mass = np.array([float((query[b].astype(float) ** 2).sum()) for b in self.blocks])
        order = np.argsort(-mass, kind="stable")
        alive = np.flatnonzero(self.ids != query_id)
        score = np.zeros(len(alive), np.int64)
        rest, left = self.total[alive], float(mass.sum())
        least = -known[k - 1][0] if len(known) >= k else None
        for step, b in enumerate(order):
            block = self.blocks[b]
            score = score + query[block] @ self.values[block][:, alive]
            rest = np.maximum(rest - self.mass[b, alive], 0)
            left = max(left - mass[b], 0.0)
            if step + 1 == len(order):
                break
            # Bounds are floats: a little room keeps them above the exact integers.
            room = np.sqrt(rest * left) * (1 + 1e-9) + 1
            if len(alive) > k:
                sure = np.partition(score - room, len(score) - k)[len(score) - k]
                floor = sure if least is None else max(sure, least)
            else:
                floor = least
            if floor is not None:
                stay = score + room >= floor
                if not stay.all():
                    alive, score, rest = alive[stay], score[stay], rest[stay]
        if least is not None:
            stay = score >= least
            alive, score = alive[stay], score[stay]
        first = np.lexsort((self.ids[alive], -score))[:k]
        found = list(zip((-score[first]).tolist(), self.ids[alive[first]].tolist()))
        return sorted(known + found)[:k]


    def _large(self, query: np.ndarray) -> bool:
        """Whether products may leave 64 bits: no sum is larger than the product of the norms."""
        if query.dtype == object or self.values.dtype == object:
            return True
        return float((query.astype(float) ** 2).sum()) * float(self.total.max(initial=0)) >= 2.0**122

    def _best_of_any_size(self, query_id: int, query: np.ndarray, k: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
        alive = np.flatnonzero(self.ids != query_id)
        scores = query.astype(object) @ self.values[:, alive].astype(object)
        found = [(-min(max(int(s), LONG[0]), LONG[1]), i) for s, i in zip(scores, self.ids[alive].tolist())]
        return sorted(known + found)[:k]


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row with ``is_query`` the ``k`` best others, ties to the smaller id."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    vectors = vectors.filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    asked = df.filter(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = asked.filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").groupBy("id").agg(F.min("v").alias("v"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked.count() // PACKET))

    def pack_queries(table: pa.Table) -> pa.Table:
        rows = _packets(table.select(["id", "v"]), scale)
        block = table["block"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block] * len(rows), pa.int32()),
                "q_dims": pa.array([r["dims"] for r in rows], pa.int32()),
                "q_wide": pa.array([r["wide"] for r in rows], pa.bool_()),
                "q_ids": pa.array([r["ids"] for r in rows], pa.binary()),
                "q_values": pa.array([r["values"] for r in rows], pa.binary()),
            }
        )

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _packets(batch, scale)
            if rows:
                kinds = [("dims", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("values", pa.binary())]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    numbered = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    queries = numbered.groupBy("block").applyInArrow(pack_queries, "block int, q_dims int, q_wide boolean, q_ids binary, q_values binary")
    queries = materialize(queries, "queries").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    packets = materialize(vectors.mapInArrow(pack_rows, PACKET_SCHEMA), "packets")
    packets = packets.select(
        "*",
        F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    # The estimated size of the salted queries is that of one copy; by it they would be broadcast with all copies.
    met = packets.join(queries.hint("merge"), ["block", "salt"]).filter("dims = q_dims").select(
        "block", "dims", "q_wide", "q_ids", "q_values", "wide", "ids", "values"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        current = None

        def flush() -> pa.RecordBatch:
            rows = [(q, i, -s) for q, found in best.items() for s, i in found]
            best.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "id", "score"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                block, dims, q_wide, q_ids, q_values, wide, ids, values = (c[i].as_py() for c in batch.columns)
                # Rows come sorted by block; vectors of another length are of other queries.
                if current not in (None, block) and best:
                    yield flush()
                current = block
                asked_ids = np.frombuffer(q_ids, np.int64)
                matrix = whole_numbers(q_values, dims, len(asked_ids), q_wide)
                packet = Candidates(dims, ids, values, wide)
                for j, query_id in enumerate(asked_ids.tolist()):
                    best[query_id] = packet.best(query_id, matrix[:, j], k, best.get(query_id, []))
        if best:
            yield flush()

    scored = met.mapInArrow(search, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score"
    )
