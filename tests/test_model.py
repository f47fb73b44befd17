import dataclasses
import json
import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearkin import fit, session
from nearkin.operators import flow, search, tokens, weights
from nearkin.plans.model import load_model
from nearkin.session import materialize
from nearkin.sources import snapshots

SENTENCES = [
    (0, "Bees like to make honey", "a"),
    (1, "Bears like to eat honey", "b"),
    (2, "Bees don't like bears", "c"),
    (3, "Humans are walking around the park", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(SENTENCES, "id bigint, text string, char string")


@pytest.fixture(scope="module", params=["none", "default", "custom"])
def fitted(request, docs):
    return fit(docs, "text", ["char"], "id", mode=request.param, label_names=["Char"])


@pytest.fixture(scope="module")
def model(fitted, tmp_path_factory):
    return fitted.save(str(tmp_path_factory.mktemp("model") / fitted.mode))


def test_each_sentence_finds_itself(model):
    rows = model.predict([t for _, t, _ in SENTENCES]).collect()
    best = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert {q: r["char"] for q, r in best.items()} == {0: "a", 1: "b", 2: "c", 3: "d"}
    assert all(r["score"] == 1.0 for r in best.values())
    for q in best:
        ranks = sorted(r["rank"] for r in rows if r["query_id"] == q)
        assert ranks == list(range(1, len(ranks) + 1))
    assert all(0 < r["score"] <= 1 for r in rows)


def test_weights_by_hand(spark):
    texts = ["red red fish", "blue fish", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").withColumn("l", F.lit(1))
    model = fit(df, "t", ["l"], "id", mode="none")
    got = {(r["doc_id"], r["term"]): r["w"] for r in model.vectors.collect()}
    docs = [Counter(t.split()) for t in texts]
    freq = Counter(term for d in docs for term in d)
    idf = {t: math.log((1 + 3) / (1 + n)) + 1 for t, n in freq.items()}
    for i, d in enumerate(docs):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in d.items()))
        for t, n in d.items():
            assert got[(i, t)] == pytest.approx(n * idf[t] / norm)
    assert len(got) == 4


def test_transform_of_fitted_docs_gives_their_vectors(model, docs):
    key = lambda df: {(r["doc_id"], r["term"]): round(r["w"], 9) for r in df.collect()}
    again = model.transform(docs.withColumnRenamed("id", "doc_id"), "doc_id")
    assert key(again) == key(model.vectors)


def test_unknown_query_and_padding(model):
    assert model.predict("zzz qqq").count() == 0
    padded = model.predict(["zzz qqq", "honey"], n_best=3, pad=True).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"]) for r in padded] == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3)]
    assert [r["doc_id"] for r in padded[:3]] == [0, 1, 2]
    assert padded[-1]["score"] == 0.0 and padded[-1]["doc_id"] == 2
    assert model.predict("zzz", n_best=9, pad=True).count() == 4


def test_predict_obj(model):
    row = model.predict_obj("honey").select(F.to_json("obj").alias("j")).first()
    obj = json.loads(row["j"])
    assert obj["Text"] == "honey"
    assert {e["Char"] for e in obj["Similar"]} == {"a", "b"} and all(e["Score"] > 0 for e in obj["Similar"])
    empty = json.loads(model.predict_obj("zzz").select(F.to_json("obj")).first()[0])
    assert empty == {"Text": "zzz", "Similar": []}


def test_predict_obj_errors(model):
    top = model.predict("honey")
    frame = model.as_frame("honey")
    with pytest.raises(ValueError):
        search.as_objects(top, frame, [], ["char"])
    with pytest.raises(ValueError):
        search.as_objects(top, frame, ["A", "B"], ["char"])


def test_stored_model_answers_like_the_fitted_one(fitted, model):
    queries = ["bears and honey", "park"]
    assert sorted(model.predict(queries).collect()) == sorted(fitted.predict(queries).collect())
    assert model.mode == fitted.mode and model.label_names == ("Char",)


def test_saving_a_stored_model_copies_it(spark, model, tmp_path):
    model.save(str(tmp_path / "copy"))
    again = load_model(spark, str(tmp_path / "copy"))
    assert sorted(again.predict("honey").collect()) == sorted(model.predict("honey").collect())


def test_stored_search_prunes_buckets(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(weights, "POSTINGS_PER_BUCKET", 2)
    model = fit(docs, "text", ["char"], "id", mode="none").save(str(tmp_path / "m"))
    assert model.buckets > 1
    plan = model.scores("honey")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert {r["doc_id"] for r in model.scores("honey").collect()} == {0, 1}


def test_shuffled_join_equals_broadcast(model, monkeypatch):
    monkeypatch.setattr(search, "POSTINGS_PER_KEY", 1)
    queries = model.transform(["bees like honey", "bears", "walk in the park"])
    key = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert key(search.dot_sparse(model.vectors, queries, True)) == key(search.dot_sparse(model.vectors, queries, False))


def test_is_small(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc"), (2, "def")], "query_id int, text string")
    assert search.is_small(df, "text")
    monkeypatch.setattr(search, "BROADCAST_TEXT_BYTES", 5)
    assert not search.is_small(df, "text")
    assert not search.is_small(df, rows=1)


def test_inspect_and_weights(model):
    top = model.inspect_doc("honey honey bears").collect()
    assert [r["term"] for r in sorted(top, key=lambda r: r["rank"])][0] == "honey"
    rows = model.get_weights("honey park honey zzz", "bees make honey").orderBy("pos").collect()
    assert [r["term"] for r in rows] == ["honey", "park", "honey", "zzz"]
    assert rows[0]["weight"] > 0 and rows[1]["weight"] == 0.0 and rows[3]["weight"] is None


def test_get_weights_keeps_case_unless_lowered(docs):
    model = fit(docs, "text", ["char"], "id", mode="none")
    assert model.get_weights("Honey", "honey").first()["weight"] is None
    assert model.get_weights("Honey", "honey", lower=True).first()["weight"] == pytest.approx(1.0)


def test_fit_without_id_and_with_duplicates(spark):
    df = spark.createDataFrame([("same words", "u1"), ("same words", "u2"), (None, "u3")], "t string, url string")
    model = fit(df, "t", ["url"], mode="none")
    rows = model.predict("words").orderBy("rank").collect()
    assert [r["score"] for r in rows] == [1.0, 1.0] and rows[0]["doc_id"] < rows[1]["doc_id"]


def test_fit_needs_unique_ids(spark):
    docs = spark.createDataFrame([(1, "red fish", "u1"), (2, "blue tree", "u2")], "id bigint, t string, url string")
    assert fit(docs, "t", ["url"], "id", mode="none").predict("red").count() == 1
    for bad in ([(1, "again", "u3")], [(None, "no id", "u3")]):
        with pytest.raises(ValueError):
            fit(docs.unionAll(spark.createDataFrame(bad, docs.schema)), "t", ["url"], "id", mode="none")


def test_flow_vectors_equal_long_form(spark):
    texts = [f"common word{i % 3} word{i % 7} tail{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = flow.fit_vectors(df, "text")
    names = model.stages[1].vocabulary
    ml = {
        (r["doc_id"], names[i]): round(v, 9)
        for r in flow.vector_col(df, model).collect()
        for i, v in zip(r["vectorRepresentation"].indices.tolist(), r["vectorRepresentation"].values.tolist())
    }
    counts = weights.count_vectorize(df)
    mine = weights.idf_min_df(counts, weights.corpus_size(df))
    got = {(r["doc_id"], r["term"]): round(r["w"], 9) for r in mine.collect()}
    assert "common" not in names
    assert {k: v for k, v in ml.items() if v} == {k: v for k, v in got.items() if v}


def test_count_vectorize_bounds(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "d")], "doc_id bigint, text string")
    out = lambda **kw: {(r[0], r[1]): r[2] for r in weights.count_vectorize(df, **kw).collect()}
    assert out(vocab_size=1) == {(1, "a"): 2.0, (2, "a"): 1.0}
    assert out(min_df=2, binary=True) == {(1, "a"): 1.0, (2, "a"): 1.0}
    assert out(min_tf=2) == {(1, "a"): 2.0}
    assert (1, "a") not in out(max_df=0.5)


def test_block_search_equals_all_scores(spark, tmp_path, monkeypatch):
    """Copies tie at the cut, some queries match few documents or none, and blocks are skipped."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(300)], k=r.randint(3, 30))) for _ in range(700)]
    texts += [texts[3]] * 40 + ["lonely word", "", None]
    docs = spark.createDataFrame([(i * 7, t, "u") for i, t in enumerate(texts)], "id long, body string, url string")
    model = fit(docs, "body", ["url"], id_col="id", mode="none", n_best=5).save(str(tmp_path / "model"))
    queries = spark.createDataFrame(
        list(enumerate([*texts[:25], texts[3], "lonely", "unknown", "", None, "w250 w251"])), "query_id long, text string"
    )
    direct = model.predict(queries).collect()
    kept = []
    monkeypatch.setattr(search, "DIRECT_POSTINGS", 0)
    monkeypatch.setattr(search, "materialize", lambda df, name: kept.append((name, out := materialize(df, name))) or out)
    assert sorted(map(tuple, model.predict(queries).collect())) == sorted(map(tuple, direct))
    bounds, *scored = [df.count() for _, df in kept]
    assert scored[-1] < 0.8 * bounds
    # Both ways of the joins.
    monkeypatch.setattr(search, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, model.predict(queries).collect())) == sorted(map(tuple, direct))
    vectors = model.transform(queries)
    assert sorted(map(tuple, search.top_blocks(model.vectors, model.blocks, vectors, False, 5, model.buckets).collect())) == sorted(
        (x["query_id"], x["doc_id"], x["score"], x["rank"]) for x in direct
    )


def test_blocks_hold_each_document_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 9} gamma{i}") for i in range(200)], "id long, body string")
    model = fit(docs, "body", ["id"], id_col="id", mode="none").save(str(tmp_path / "model"))
    sizes = model.vectors.select("doc_id", "block").distinct().groupBy("block").count().collect()
    assert sum(x["count"] for x in sizes) == 200 and max(x["count"] for x in sizes) <= search.BLOCK_DOCS
    most = {(x["term"], x["block"]): x["most"] for x in model.blocks.collect()}
    for x in model.vectors.collect():
        assert x["w"] <= most[x["term"], x["block"]]


def test_block_weights_lie_beside_the_vectors(spark, tmp_path, monkeypatch):
    """One row of each term and block holds the largest weight, common terms spread over files included."""
    monkeypatch.setattr(weights, "POSTINGS_PER_FILE", 40)
    docs = spark.createDataFrame([(i, f"alpha alpha{i % 2} beta{i % 9} gamma{i}" + " delta" * (i % 5)) for i in range(300)], "id long, body string")
    model = fit(docs, "body", ["id"], id_col="id", mode="none").save(str(tmp_path / "model"))
    assert not list(tmp_path.glob("model/*/blocks")) and "most" not in model.vectors.columns
    best = {}
    for x in model.vectors.collect():
        best[x["term"], x["block"]] = max(x["w"], best.get((x["term"], x["block"]), 0))
    rows = model.blocks.collect()
    assert {(x["term"], x["block"]): x["most"] for x in rows} == best and len(rows) == len(best)
    # Models of earlier versions keep a table of their own.
    again = model.save(str(tmp_path / "again"))
    base = str(next(tmp_path.glob("again/model-*")))
    old, params = f"{tmp_path}/before/old", spark.read.parquet(f"{base}/params").withColumn("has_blocks", F.lit(True))
    for name in ("vocab", "labels"):
        spark.read.parquet(f"{base}/{name}").write.parquet(f"{old}/{name}")
    again.vectors.write.partitionBy("bucket").parquet(f"{old}/vectors")
    again.blocks.write.partitionBy("bucket").parquet(f"{old}/blocks")
    params.write.parquet(f"{old}/params")
    snapshots.publish(spark, f"{tmp_path}/before", [old])
    assert load_model(spark, f"{tmp_path}/before").blocks.count() == len(again.blocks.collect())


def test_failed_save_leaves_the_model(spark, tmp_path):
    path = str(tmp_path / "model")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id long, body string")
    with pytest.raises(FileNotFoundError):
        load_model(spark, path)
    old = fit(docs, "body", ["id"], id_col="id", mode="none").save(path)
    with pytest.raises(FileExistsError):
        old.save(path)
    new = fit(docs.withColumn("body", F.concat("body", F.lit(" delta"))), "body", ["id"], id_col="id", mode="none")
    broken = dataclasses.replace(new, vocab=new.vocab.withColumn("idf", F.expr("IF(term = 'beta', raise_error('lost'), idf)")))
    with pytest.raises(Exception, match="lost"):
        broken.save(path, mode="overwrite")
    assert load_model(spark, path).vocab.count() == 3
    assert new.save(path, mode="overwrite").vocab.count() == 4
    # A reader of the version before still has all its tables.
    assert old.vocab.count() == 3 and old.predict("alpha").count() == 1


def test_fit_cuts_texts_into_tokens_once(spark, monkeypatch):
    seen = []
    real = tokens.token_rows
    monkeypatch.setattr(tokens, "token_rows", lambda *a, **b: seen.append(1) or real(*a, **b))
    docs = spark.createDataFrame([(1, "red fishes walk"), (2, "blue fish"), (3, None)], "id bigint, t string")
    model = fit(docs, "t", ["t"], "id", mode="default")
    assert len(seen) == 1
    assert {r["term"]: r["df"] for r in model.vocab.collect()} == {"red": 1, "fish": 2, "walk": 1, "blue": 1}
    assert {r["token"] for r in model.lexicon.collect()} == {"red", "fishes", "walk", "blue", "fish"}


@pytest.mark.parametrize("mode", ["none", "default"])
def test_save_in_rounds_with_rare_terms(spark, tmp_path, monkeypatch, mode):
    """Terms beyond those broadcast and buckets laid out one after the other give the vectors of the fitted model."""
    r = random.Random(6)
    words = [f"{x}{y}ing" for x in "bcdfghklmnprst" for y in ("al", "en", "ir", "od")]
    texts = [" ".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randint(1, 20))) for _ in range(120)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    plain = fit(docs, "body", ["id"], id_col="id", mode=mode)
    monkeypatch.setattr(tokens, "VOCAB_ROWS", 12)
    monkeypatch.setattr(weights, "POSTINGS_PER_BUCKET", 60)
    monkeypatch.setattr(weights, "POSTINGS_PER_FILE", 25)
    monkeypatch.setattr(weights, "POSTINGS_PER_ROUND", 200)
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{scratch}/{name}-{uuid.uuid4().hex}")
    few = fit(docs, "body", ["id"], id_col="id", mode=mode)
    freed = []
    monkeypatch.setattr("nearkin.plans.model.free_shuffles", lambda spark: freed.append(1))
    stored = few.save(str(tmp_path / "model"))
    assert len(freed) > 2 and stored.buckets > 4
    left = ["bags", "vocab"] if mode == "none" else ["bags", "lexicon", "vocab"]
    assert sorted(p.name.split("-")[0] for p in scratch.iterdir()) == left
    key = lambda df: sorted((x["doc_id"], x["term"], x["tf"], x["df"], round(x["w"], 9)) for x in df.collect())
    assert key(stored.vectors) == key(plain.vectors) == key(few.vectors)
    sizes = stored.vectors.select("doc_id", "block").distinct().groupBy("block").count().collect()
    assert sum(x["count"] for x in sizes) == few.bags.count() and max(x["count"] for x in sizes) <= search.BLOCK_DOCS
    best = {}
    for x in stored.vectors.collect():
        best[x["term"], x["block"]] = max(x["w"], best.get((x["term"], x["block"]), 0))
    rows = stored.blocks.collect()
    assert {(x["term"], x["block"]): x["most"] for x in rows} == best and len(rows) == len(best)


def test_only_rare_terms_are_moved_to_be_joined(spark, monkeypatch):
    monkeypatch.setattr(tokens, "VOCAB_ROWS", 3)
    terms = materialize(spark.createDataFrame([(f"t{i}", 100 if i < 3 else i % 3 + 1) for i in range(50)], "term string, df long"), "terms")
    common, rest = tokens.common_terms(terms)
    assert {x["term"] for x in common.collect()} == {"t0", "t1", "t2"} and rest.count() == 47
    rows = spark.createDataFrame([(i, f"t{i % 50}") for i in range(300)], "id long, term string")
    got = sorted((x["id"], x["term"], x["df"]) for x in tokens.join_terms(rows, terms, "term").collect())
    assert got == [(i, f"t{i % 50}", 100 if i % 50 < 3 else i % 50 % 3 + 1) for i in range(300)]
    assert tokens.common_terms(common) == (common, None)
