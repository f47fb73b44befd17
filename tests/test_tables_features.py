import statistics

import pytest
from pyspark.sql import functions as F

from nearkin import sources as S
from nearkin.sources import snapshots
from nearkin.operators import features, tables


def test_scan_dir_mixes_formats_and_skips_others(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(2, 'say "hi",\nnext line', 0.5)], "id int, t string, v double")
    path = str(tmp_path / "d")
    a.write.parquet(path)
    S.write_csv(b, path, mode="append")
    (tmp_path / "d" / "notes.txt").write_text("skip me")
    rows = {r["id"]: r for r in S.scan_dir(spark, path, "id int, t string, v double").collect()}
    assert rows[1]["v"] is None and rows[2]["t"] == 'say "hi",\nnext line' and len(rows) == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        S.scan_dir(spark, str(tmp_path / "empty"))


def test_get_or_build(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "t")
    assert S.get_or_build(spark, path, build).count() == 1
    assert S.get_or_build(spark, path, build).count() == 1
    assert S.get_or_build(spark, path, build, force=True).count() == 2
    assert len(calls) == 2


def test_csv_keeps_empty_and_null_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a\\b")], "id int, t string")
    S.write_csv(df, str(tmp_path / "c"))
    back = S.scan_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_missing_csv_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.scan_csv(spark, str(tmp_path / "none.csv"), "a int")


def test_export_nested(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2])], "id int, v array<int>")
    S.export(df, str(tmp_path / "c"))
    assert S.scan_csv(spark, str(tmp_path / "c"), "id int, v string").first()["v"] == "[1,2]"
    S.export(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).first()["v"] == [1, 2]
    with pytest.raises(ValueError):
        S.export(df, str(tmp_path / "x"), "xml")


def test_chunks(spark):
    chunks = [len(c) for c in S.iterate_chunks(spark.range(25), 10)]
    assert chunks == [10, 10, 5]
    assert [r["id"] for r in S.preview(spark.range(25), "id", 3).collect()] == [0, 1, 2]


def test_query_eq(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "b")], "x int, y string")
    assert tables.query_eq(df, x=1, y="a").count() == 1
    assert tables.query_eq(df, y=None).count() == 0
    with pytest.raises(ValueError):
        tables.query_eq(df)


def test_infer_and_cast(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "2024-01-01", "x", None), ("-2", "3", "FALSE", "2024-01-01 10:00:00", "1", None)],
        "a string, b string, c string, d string, e string, f string",
    )
    assert tables.infer_types(df) == {
        "a": "bigint", "b": "double", "c": "boolean", "d": "timestamp_ntz", "e": "string", "f": "string",
    }
    bad = tables.infer_and_cast(df, {"e": "bigint"}).select("e").collect()
    assert [r["e"] for r in bad] == [None, 1]


def test_rejects_and_declared_schema(spark):
    df = spark.createDataFrame(
        [(1, "7", "x", "true"), (2, "n/a", None, "maybe"), (3, None, "y", "false"), (2, "n/a", None, "maybe"), (None, "", "z", "")],
        "row bigint, number string, title string, closed string",
    )
    bad = tables.cast_rejects(df, tables.TICKET_SCHEMA, ["row"])
    twice = [(2, "number", "bigint", "n/a"), (2, "closed", "boolean", "maybe")] * 2
    rest = [(None, "number", "bigint", ""), (None, "closed", "boolean", "")]
    assert sorted(map(str, map(tuple, bad.collect()))) == sorted(map(str, twice + rest))
    out = tables.conform(df)
    assert out.columns == list(tables.TICKET_SCHEMA) and len(out.columns) == 30
    assert dict(out.dtypes) == tables.TICKET_SCHEMA
    nulls = sum((r["number"] is None) + (r["closed"] is None) for r in out.collect())
    assert nulls == bad.count() + df.filter("number IS NULL").count()
    assert tables.cast_rejects(df, {"absent": "bigint"}, ["row"]).count() == 0
    assert tables.cast_rejects(df.limit(0), tables.TICKET_SCHEMA, ["row"]).count() == 0
    with pytest.raises(ValueError):
        tables.cast_rejects(df.withColumn("value", F.lit(1)), tables.TICKET_SCHEMA, ["value"])


def test_unions(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1,), (1,)], "x int")
    assert tables.concat_rows([a, b]).count() == 3
    assert tables.concat_dedupe([a, b], dedupe=True).count() == 2
    assert tables.distinct_values(b, "x").count() == 1


@pytest.mark.parametrize("sort_rows", [100_000, 3])
def test_split_positional(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(features, "SORT_ROWS", sort_rows)
    monkeypatch.setattr(features, "BINS", 4)
    ids = [(i * i * 7 - 300,) for i in range(101)]
    out = features.split_positional(spark.createDataFrame(ids, "id bigint"), "id").collect()
    expect = {i for (i,) in sorted(ids)[: int(0.8 * 101)]}
    assert {r["id"] for r in out if r["split"] == "train"} == expect and len(out) == 101
    empty = features.split_positional(spark.createDataFrame([], "id bigint"), "id")
    assert empty.count() == 0


def test_hash_splits_repeat(spark):
    df = spark.range(2000)
    one = features.split_random(df, "id")
    assert one.exceptAll(features.split_random(df.repartition(3), "id")).isEmpty()
    assert 1500 < one.filter("split = 'train'").count() < 1700
    folds = {r["fold"]: r["count"] for r in features.kfold(df, "id").groupBy("fold").count().collect()}
    assert set(folds) == set(range(5)) and min(folds.values()) > 300


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    out = features.standardize(df, ["a", "b"]).collect()
    mean, std = 3.0, statistics.pstdev([1.0, 2.0, 6.0])
    assert [r["a"] for r in out] == pytest.approx([(x - mean) / std for x in (1.0, 2.0, 6.0)])
    assert {r["b"] for r in out} == {0.0}
    on_train = features.standardize(df, ["a"], df.filter("a < 5")).collect()
    assert [r["a"] for r in on_train] == pytest.approx([-1.0, 1.0, 9.0])


def test_error_gate(spark):
    df = spark.createDataFrame([(1, 1)] * 19 + [(1, 0)], "y int, p int")
    row = features.error_gate(df, "y", "p").first()
    assert (row["total"], row["wrong"], row["error"], row["passed"]) == (20, 1, 0.05, True)
    assert not features.error_gate(df.limit(0).union(spark.createDataFrame([(1, 0)], "y int, p int")), "y", "p").first()["passed"]


def test_scaling_and_order(spark):
    df = spark.createDataFrame([(1, 250000.0)], "id int, price double")
    out = tables.label_first(tables.scale_const(df, "price"), "price")
    assert out.columns == ["price", "id"] and out.first()["price"] == 2.5
    assert tables.drop_cols(df, "id").columns == ["price"]


def test_corpus_labels_keep_types(spark):
    df = spark.createDataFrame([("t", 1, True)], "text string, n int, b boolean")
    label = tables.corpus_labels(df, "text", ["n", "b"]).select(F.col("label")).first()["label"]
    assert label["n"] == 1 and label["b"] is True


def test_half_written_cache_is_built_again(spark, tmp_path):
    path = str(tmp_path / "t")

    def broken():
        # The write begins and fails.
        return spark.range(100).selectExpr("IF(id = 99, raise_error('lost'), id) AS id")

    with pytest.raises(Exception, match="lost"):
        S.get_or_build(spark, path, broken)
    spark.range(3).write.parquet(f"{path}/data-left")
    assert S.get_or_build(spark, path, lambda: spark.range(7)).count() == 7
    with pytest.raises(Exception, match="lost"):
        S.get_or_build(spark, path, broken, force=True)
    assert S.get_or_build(spark, path, broken).count() == 7


def test_cached_dir_reads_new_files_only(spark, tmp_path):
    direc, path = tmp_path / "in", str(tmp_path / "cache")
    direc.mkdir()
    with pytest.raises(ValueError):
        S.cached_dir(spark, path, str(direc))

    def add(name, rows, columns="id long, text string"):
        df = spark.createDataFrame(rows, columns).toPandas()
        df.to_parquet(direc / name) if name.endswith("parquet") else df.to_csv(direc / name, index=False)

    def cached():
        return sorted(tuple(r) for r in S.cached_dir(spark, path, str(direc), "id long, text string").select("id", "text").collect())

    add("a.parquet", [(1, "x"), (2, "y")])
    (direc / "notes.txt").write_text("skipped")
    assert cached() == [(1, "x"), (2, "y")]
    add("b.csv", [(3, "z")])
    assert cached() == [(1, "x"), (2, "y"), (3, "z")]
    before = snapshots.current(spark, path)
    assert before["version"] == 2 and len(before["folders"]) == 2
    assert cached() == [(1, "x"), (2, "y"), (3, "z")] and snapshots.current(spark, path) == before
    add("b.csv", [(3, "changed"), (4, "w")])
    assert cached() == [(1, "x"), (2, "y"), (3, "changed"), (4, "w")] and len(snapshots.current(spark, path)["folders"]) == 1
    (direc / "a.parquet").unlink()
    assert cached() == [(3, "changed"), (4, "w")]


def test_sample_is_cut_alike_each_time(spark, tmp_path):
    rows = [(i % 50, f"t{i % 300}", [i]) for i in range(900)] + [(None, "t", None)] * 9
    path = str(tmp_path / "s")
    spark.createDataFrame(rows, "id long, text string, v array<int>").repartition(5).write.parquet(path)
    first = sorted(map(str, S.scan_sampled(spark, path, limit=100).collect()))
    spark.read.parquet(path).repartition(2).write.parquet(f"{path}2")
    assert len(first) == 100 and first == sorted(map(str, S.scan_sampled(spark, f"{path}2", limit=100).collect()))
    by_id = S.scan_sampled(spark, path, limit=100, order_by="id").collect()
    assert sorted(r["id"] for r in by_id) == sorted(r[0] for r in rows if r[0] is not None)[:100]
    assert S.scan_sampled(spark, path, limit=905, order_by="id").filter("id IS NULL").count() == 5
    assert S.scan_sampled(spark, path, limit=5000).count() == 909


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "repeat('x', 50) AS t").coalesce(1)
    S.write_csv(df, str(tmp_path / "c"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert S.scan_csv(spark, str(tmp_path / "c"), df.schema).rdd.getNumPartitions() == 1
        whole = S.scan_csv(spark, str(tmp_path / "c"), df.schema, multi_line=False)
        assert whole.rdd.getNumPartitions() > 3 and whole.count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
