"""Dense vectors: scores of every vector against a set of query vectors, signed values allowed.

Numpy multiplies a batch of vectors by the query matrix inside each task and keeps the best ``n`` per query, so a
task hands on at most ``n`` rows per query and the vectors themselves are never shuffled.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.operators.search import BROADCAST_ROWS, DECIMALS, label_lookup, top_n
from nearkin.session import materialize

# Executors get the numpy code with the task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Query values (rows × length) sent to every task.
MAX_QUERY_VALUES = 4_000_000
# Scores a task holds at a time.
MAX_SCORES = 4_000_000
OUT = "query_id bigint, doc_id bigint, score double"


def dot_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return queries @ vectors.T


def cosine_skip_nan_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine over the coordinates where neither side is NaN; 1.0 when either kept norm is zero."""
    q_kept, v_kept = ~np.isnan(queries), ~np.isnan(vectors)
    q, v = np.where(q_kept, queries, 0.0), np.where(v_kept, vectors, 0.0)
    norms = np.sqrt((q * q) @ v_kept.T.astype(float)) * np.sqrt(q_kept.astype(float) @ (v * v).T)
    return np.where(norms == 0, 1.0, (q @ v.T) / np.where(norms == 0, 1.0, norms))


SCORERS = {"dot": dot_scores, "cosine_nan": cosine_skip_nan_scores}


class _Best:
    """The best ``n`` per query over the batches of one task."""

    def __init__(self, score: Callable, query_ids: np.ndarray, queries: np.ndarray, n: int):
        self.score, self.query_ids, self.queries, self.n = score, query_ids, queries, n
        self.ids = np.empty((len(query_ids), 0), dtype=np.int64)
        self.scores = np.empty((len(query_ids), 0))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        step = max(1, MAX_SCORES // len(self.query_ids))
        for start in range(0, len(ids), step):
            scores = np.round(self.score(self.queries, vectors[start : start + step]), DECIMALS)
            self._merge(ids[start : start + step], scores)

    def _merge(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.ids.shape[1] == self.n:
            # Only vectors that reach some query's last place matter.
            reach = (scores >= self.scores[:, -1:]).any(axis=0)
            ids, scores = ids[reach], scores[:, reach]
        all_ids = np.hstack([self.ids, np.broadcast_to(ids, scores.shape)])
        all_scores = np.hstack([self.scores, scores])
        keep = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.n]
        self.ids = np.take_along_axis(all_ids, keep, axis=1)
        self.scores = np.take_along_axis(all_scores, keep, axis=1)

    def frame(self) -> pd.DataFrame:
        width = self.ids.shape[1]
        return pd.DataFrame(
            {
                "query_id": np.repeat(self.query_ids, width),
                "doc_id": self.ids.ravel(),
                "score": self.scores.ravel(),
            }
        )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _score_partition(score: Callable, query_ids: np.ndarray, matrix: np.ndarray, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(score, query_ids, matrix, n)
        for batch in batches:
            if len(batch):
                best.add(batch["doc_id"].to_numpy(), _matrix(batch["vec"]))
        yield best.frame()

    return run


def _score_block(score: Callable, n: int):
    def run(_key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        best = _Best(score, queries["query_id"].to_numpy(), _matrix(queries["vec"]), n)
        best.add(vectors["doc_id"].to_numpy(), _matrix(vectors["vec"]))
        return best.frame()

    return run


def dense_top_n(
    vectors: DataFrame,
    queries: DataFrame,
    n: int = 10,
    scorer: str = "dot",
    max_query_values: int = MAX_QUERY_VALUES,
    block_rows: int = 20_000,
) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` from ``vectors(doc_id, vec)`` and ``queries(query_id, vec)``.

    A query set of at most ``max_query_values`` numbers is sent to the tasks. A larger one is cut into blocks,
    as are the vectors, and each pair of blocks is scored by one task of bounded size.
    Vectors and queries that are null, hold a null, have another length than the longest query or, under ``dot``, hold NaN
    take no part.
    """
    score = SCORERS[scorer]
    queries = queries.select("query_id", "vec")
    length = queries.agg(F.max(F.size("vec"))).first()[0] or 0
    bad = lambda x: x.isNull() | (F.isnan(x) if scorer == "dot" else F.lit(False))
    whole = F.col("vec").isNotNull() & (F.size("vec") == length) & ~F.exists("vec", bad)
    vectors, queries = vectors.filter(whole), queries.filter(whole)
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("len")).first()
    rows, length = size["n"], max(size["len"] or 0, 1)
    if rows * length <= max_query_values:
        local = queries.select("query_id", "vec").toPandas()
        if local.empty:
            return vectors.sparkSession.createDataFrame([], OUT + ", rank int")
        run = _score_partition(score, local["query_id"].to_numpy(), _matrix(local["vec"]), n)
        return top_n(vectors.select("doc_id", "vec").mapInPandas(run, OUT), n)
    q_blocks = math.ceil(rows * length / max_query_values)
    v_blocks = max(1, math.ceil(vectors.count() / block_rows))

    def blocked(df: DataFrame, id_col: str, own: str, count: int, other: str, others: int) -> DataFrame:
        return df.select(
            id_col, "vec", F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int").alias(own)
        ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    q = blocked(queries, "query_id", "qb", q_blocks, "vb", v_blocks)
    v = blocked(vectors, "doc_id", "vb", v_blocks, "qb", q_blocks)
    scored = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(
        _score_block(score, n), OUT
    )
    return top_n(scored, n)


def dense_predict(vectors: DataFrame, labels: DataFrame, queries: DataFrame, n: int = 10, scorer: str = "dot") -> DataFrame:
    """``dense_top_n`` and the label columns of ``labels(doc_id, …)``, which must have one row per vector."""
    ids = vectors.select("doc_id").join(labels.select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    seen = ids.agg(F.count("*").alias("rows"), F.count("known").alias("known")).first()
    if seen["rows"] != seen["known"] or seen["rows"] != vectors.count():
        raise ValueError("every vector needs one label row")
    few = queries.count() * n <= BROADCAST_ROWS
    top = dense_top_n(vectors, queries, n, scorer)
    return label_lookup(materialize(top, "top") if few else top, labels, few)
