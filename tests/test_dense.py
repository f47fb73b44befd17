import math
import random

import pytest
from pyspark.sql import functions as F

from nearkin.functions import vectors as V
from nearkin.operators.dense import dense_predict, dense_top_n

SCHEMA_V, SCHEMA_Q = "doc_id bigint, vec array<double>", "query_id bigint, vec array<double>"


def test_unit_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, -1.0])], SCHEMA_V)
    out = dense_top_n(vectors, spark.createDataFrame([(7, [0.5, 1.0])], SCHEMA_Q)).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in out] == [(1, 1.0), (0, 0.5), (2, -0.5), (3, -1.0)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)

    def vec():
        return [float("nan") if rng.random() < 0.2 else rng.uniform(-1, 1) for _ in range(6)]

    vs = [(i, vec()) for i in range(60)] + [(60, [float("nan")] * 6), (61, [0.0] * 6)]
    qs = [(i, vec()) for i in range(9)]
    return vs, qs, spark.createDataFrame(vs, SCHEMA_V).repartition(3), spark.createDataFrame(qs, SCHEMA_Q)


def cosine(u, v):
    kept = [(x, y) for x, y in zip(u, v) if not (math.isnan(x) or math.isnan(y))]
    nu, nv = math.sqrt(sum(x * x for x, _ in kept)), math.sqrt(sum(y * y for _, y in kept))
    return 1.0 if nu == 0 or nv == 0 else sum(x * y for x, y in kept) / (nu * nv)


@pytest.mark.parametrize("limit", [10**6, 12])
def test_cosine_skips_nan_in_both_ways(data, limit):
    vs, qs, vectors, queries = data
    out = dense_top_n(vectors, queries, 5, "cosine_nan", max_query_values=limit, block_rows=20).collect()
    for q, u in qs:
        expect = sorted(((-round(cosine(u, v), 6), i) for i, v in vs))[:5]
        got = [(r["doc_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [i for i, _ in got] == [i for _, i in expect]
        assert [s for _, s in got] == pytest.approx([-s for s, _ in expect])


def test_column_forms_agree(data):
    _, _, vectors, queries = data
    pairs = vectors.filter("doc_id < 9").join(queries.select(F.col("query_id").alias("doc_id"), F.col("vec").alias("q")), "doc_id")
    for r in pairs.select("vec", "q", V.cosine_skip_nan(F.col("vec"), F.col("q")).alias("c")).collect():
        assert r["c"] == pytest.approx(cosine(r["vec"], r["q"]))
    df = pairs.select(V.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))).alias("d"))
    assert df.first()["d"] == 1.0


def test_no_queries(data, spark):
    _, _, vectors, queries = data
    assert dense_top_n(vectors, queries.filter("false")).count() == 0


def test_bad_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, SCHEMA_V)
    queries = spark.createDataFrame([(7, [0.5, 1.0]), (8, None), (9, [1.0])], SCHEMA_Q)
    assert [(r["query_id"], r["doc_id"]) for r in dense_top_n(vectors, queries).orderBy("rank").collect()] == [(7, 5), (7, 0)]


def test_labels_of_dense_matches(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], SCHEMA_V)
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id bigint, name string")
    queries = spark.createDataFrame([(7, [0.5, 1.0])], SCHEMA_Q)
    assert [(r["rank"], r["name"]) for r in dense_predict(vectors, labels, queries).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    for wrong in (labels.limit(1), labels.unionAll(labels)):
        with pytest.raises(ValueError):
            dense_predict(vectors, wrong, queries)
