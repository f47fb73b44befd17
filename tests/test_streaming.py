import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from nearkin import fit
from nearkin.operators import weights
from nearkin.streaming import serving


def test_parse_requests(spark):
    bodies = [('{"data": "password manager autofill"}',), ("not json",), ('{"other": 1}',), (None,)]
    out = serving.parse_requests(spark.createDataFrame(bodies, "body string")).collect()
    assert [r["text"] for r in out] == ["password manager autofill", None, None, None]
    assert [r["ok"] for r in out] == [True, False, False, False]


def test_stream_score_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish"), (3, "tree")], "id bigint, t string")
    model = fit(docs, "t", ["t"], "id", mode="none").save(str(tmp_path / "m"))
    requests = spark.createDataFrame([(1, "fish"), (2, "red"), (3, "zzz")], "query_id bigint, text string")
    requests.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = serving.stream_files(spark, str(tmp_path / "in"), requests.schema, maxFilesPerTrigger=1)
    serving.stream_score(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("run_id", "batch_id").collect()
    assert sorted(got) == sorted(model.predict(requests).collect())


@pytest.mark.parametrize("files", [0, 3])
def test_streamed_table_is_a_file_or_a_folder(spark, tmp_path, files):
    docs = spark.createDataFrame([(i, f"fish number{i}") for i in range(9)], "doc_id bigint, text string")
    docs.repartition(files or 1).write.parquet(str(tmp_path / "written"))
    if files:
        (tmp_path / "written").rename(tmp_path / "documents.parquet")
    else:
        next((tmp_path / "written").glob("part-*")).rename(tmp_path / "documents.parquet")
    docs.write.parquet(str(tmp_path / "other.parquet"))
    stream = serving.stream_table(spark, str(tmp_path), "documents", docs.schema)
    serving.catalog_append(stream, str(tmp_path / "cat"), str(tmp_path / "cp")).awaitTermination()
    freq = {r["term"]: r["df"] for r in serving.refresh_vocab(spark, str(tmp_path / "cat")).collect()}
    assert freq["fish"] == 9 and freq["number3"] == 1 and len(freq) == 10


def test_catalog_append_over_batches(spark, tmp_path):
    first = spark.createDataFrame([(1, "red fish"), (1, "red fish"), (2, "blue")], "doc_id bigint, text string")
    later = spark.createDataFrame([(2, "changed"), (3, "red tree")], "doc_id bigint, text string")

    def pull():
        stream = serving.stream_files(spark, str(tmp_path / "in"), first.schema)
        serving.catalog_append(stream, str(tmp_path / "cat"), str(tmp_path / "cp")).awaitTermination()

    first.write.parquet(str(tmp_path / "in"))
    pull()
    later.write.mode("append").parquet(str(tmp_path / "in"))
    pull()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "cat" / "docs")).collect()}
    assert docs == {1: "red fish", 2: "blue", 3: "red tree"}
    freq = {r["term"]: r["df"] for r in serving.refresh_vocab(spark, str(tmp_path / "cat")).collect()}
    assert freq == {"red": 2, "fish": 1, "blue": 1, "tree": 1}


def test_new_checkpoint_adds_to_catalog_and_scores(spark, tmp_path):
    schema = "doc_id bigint, text string"
    model = fit(spark.createDataFrame([(1, "red fish")], schema), "text", ["text"], "doc_id", mode="none").save(str(tmp_path / "m"))
    for i, text in ((1, "red fish"), (2, "blue tree")):
        spark.createDataFrame([(i, text)], schema).write.parquet(str(tmp_path / f"in{i}"))
        stream = serving.stream_files(spark, str(tmp_path / f"in{i}"), schema)
        serving.catalog_append(stream, str(tmp_path / "cat"), str(tmp_path / f"cp{i}")).awaitTermination()
        asked = serving.stream_files(spark, str(tmp_path / f"in{i}"), schema).selectExpr("doc_id AS query_id", "'red' AS text")
        serving.stream_score(asked, model, str(tmp_path / "out"), str(tmp_path / f"scp{i}")).awaitTermination()
    assert {r["doc_id"] for r in serving.catalog_docs(spark, str(tmp_path / "cat")).collect()} == {1, 2}
    assert {r["query_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2}


def test_catalog_versions_and_search(spark, tmp_path):
    schema = "doc_id bigint, text string, at bigint"
    cat = str(tmp_path / "cat")

    def pull(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = serving.stream_files(spark, str(tmp_path / "in"), schema)
        serving.catalog_append(stream, cat, str(tmp_path / "cp"), order_by="at").awaitTermination()

    pull([(1, "red fish", 1), (1, "red whale", 2), (2, "blue fish", 1)])
    pull([(2, "green tree", 5), (1, "old news", 0), (3, "fish soup", 1)])
    docs = {r["doc_id"]: r["text"] for r in serving.catalog_docs(spark, cat, order_by="at").collect()}
    assert docs == {1: "red whale", 2: "green tree", 3: "fish soup"}
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, name string")
    found = serving.catalog_model(spark, cat, labels, order_by="at").predict("fish tree")
    expected = fit(
        spark.createDataFrame([(*x, n) for x, n in zip(docs.items(), "abc")], "doc_id bigint, text string, name string"),
        "text", ["name"], "doc_id", mode="none",
    ).predict("fish tree")
    assert sorted(found.collect()) == sorted(expected.collect()) and found.count() == 2


def test_feedback_drops_late_and_shows_open_days(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "up", 1.0), ("2024-01-01 11:00:00", "up", 2.0), ("2024-01-02 12:00:00", "down", 1.0)]
    df = spark.createDataFrame(rows, "ts string, vote string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    late = spark.createDataFrame(
        [("2024-01-01 09:00:00", "up", 9.0), ("2024-01-02 13:00:00", "down", 2.0), ("2024-01-04 00:00:00", "up", 1.0)],
        "ts string, vote string, v double",
    )
    late = late.withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def run():
        events = serving.stream_files(spark, str(tmp_path / "in"), df.schema)
        counts = serving.feedback_counts(events, "ts", "vote", F.col("v"))
        serving.run_updates(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        found = serving.latest_updates(spark.read.parquet(str(tmp_path / "out")), ["window_start", "window_end", "vote"])
        return {(str(r["window_start"])[:10], r["vote"]): (r["votes"], r["total"]) for r in found.collect()}

    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run() == {("2024-01-01", "up"): (2, 3.0), ("2024-01-02", "down"): (1, 1.0)}
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {("2024-01-01", "up"): (2, 3.0), ("2024-01-02", "down"): (2, 3.0), ("2024-01-04", "up"): (1, 1.0)}
    batch = serving.feedback_counts(df, "ts", "vote", F.col("v"))
    assert batch.count() == 2


def test_vocab_from_changes_equals_full_rerun(spark, tmp_path):
    """Versions, late older versions, texts without terms and repeated rows over several batches, merged twice."""
    r = random.Random(2)
    schema = "doc_id bigint, text string, at bigint"
    cat = str(tmp_path / "cat")
    words = "red blue green fish whale tree moss fern".split()

    def full():
        counts = serving.catalog_counts(spark, cat, order_by="at")
        docs = serving.catalog_docs(spark, cat, order_by="at")
        return sorted(map(tuple, weights.idf(weights.doc_freq(counts), weights.corpus_size(docs)).collect()))

    merges = []
    for batch in range(6):
        rows = [(r.randint(0, 12), " ".join(r.choices(words, k=r.randint(0, 4))), r.randint(0, 3) + batch // 2) for _ in range(9)]
        spark.createDataFrame(rows + rows[:2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = serving.stream_files(spark, str(tmp_path / "in"), schema)
        serving.catalog_append(stream, cat, str(tmp_path / "cp"), order_by="at").awaitTermination()
        merges.append(serving.compact_vocab(spark, cat, every=2))
        if batch in (0, 2, 5):
            assert sorted(map(tuple, serving.refresh_vocab(spark, cat).collect())) == full()
    assert merges == [False, True] * 3
    assert len(serving.snapshots.current(spark, f"{cat}/freq_merged")["folders"]) == 1


def test_late_votes_are_counted_apart(spark, tmp_path):
    schema, out = "ts timestamp, vote string, v double", str(tmp_path / "out")
    batches = [
        [("2024-01-03 12:00:00", "up", 1.0), ("2024-01-01 09:00:00", "up", 2.0)],
        [("2024-01-01 10:00:00", "up", 4.0), ("2024-01-03 08:00:00", "down", 8.0), (None, "up", 16.0)],
        [("2024-01-02 23:30:00", "down", 32.0), ("2024-01-03 00:10:00", "up", 64.0)],
    ]

    def run(checkpoint, **options):
        stream = serving.stream_files(spark, str(tmp_path / "in"), schema)
        serving.count_votes(stream, "ts", "vote", F.col("v"), out, str(tmp_path / checkpoint), **options).awaitTermination()

    def found(late):
        rows = serving.votes(spark, out, "vote", late).collect()
        return {(str(r["window_start"])[:10], r["vote"]): (r["votes"], r["total"]) for r in rows}

    for rows in batches:
        df = spark.createDataFrame([(r[0], *r[1:]) for r in rows], "t string, vote string, v double")
        df.select(F.col("t").cast("timestamp").alias("ts"), "vote", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run("cp")
    run("cp")
    assert found(True) == {("2024-01-01", "up"): (1, 4.0), ("2024-01-02", "down"): (1, 32.0)}
    assert found(False) == {("2024-01-03", "up"): (2, 65.0), ("2024-01-01", "up"): (1, 2.0), ("2024-01-03", "down"): (1, 8.0)}
    twin = serving.feedback_counts(spark.read.schema(schema).parquet(str(tmp_path / "in")), "ts", "vote", F.col("v")).collect()
    assert found(None) == {(str(r["window_start"])[:10], r["vote"]): (r["votes"], r["total"]) for r in twin}
    before = found(None)
    with pytest.raises(StreamingQueryException):
        run("other")
    assert found(None) == before
    run("third", add=True)
    assert found(None) == {k: (2 * n, 2 * t) for k, (n, t) in before.items()}
