"""The registered queries: each operator run over the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin import sources as S
from nearkin.functions import text as T
from nearkin.operators import (
    cleaning, dense, duplicates, features, flow, inspect, search, tables, tokens, weights,
)
from nearkin.plans import model as plan_model
from nearkin.plans.model import SimilarityModel, fit
from nearkin.session import materialize, scratch_path, spread
from nearkin.streaming import serving

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
N_BEST = 10
MIN_SHARE = 0.1
NEAR = 0.8


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str):
    return F.round(c, search.DECIMALS).alias(c)


def joined(df: DataFrame, c, name: str = "tokens") -> DataFrame:
    """Token arrays as text and their length, which any engine compares alike."""
    return df.select("doc_id", F.size(c).cast("bigint").alias("n"), F.array_join(c, " ").alias(name))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown tickets made of the documents and pages: heading, text, link, address and code block."""
    pages = table(spark, sf, "pages").withColumnRenamed("url", "page_url")
    docs = spread(table(spark, sf, "documents"))
    body = F.concat(
        F.lit("## Describe the issue\n\n"),
        F.col("text"),
        F.lit("\n\nReported in *"), F.col("lang"), F.lit("* for _"), F.col("source"), F.lit("_ and ~nothing~ else.\n"),
        F.coalesce(
            F.concat(
                F.lit("\nSee [the page]("), F.col("page_url"), F.lit(") or "), F.col("page_url"),
                F.lit(" .\n\n```\n"), F.col("html"), F.lit("\n```\nUse `page_id` here.\n"),
            ),
            F.lit(""),
        ),
    )
    return docs.join(pages, F.col("doc_id") == F.col("page_id"), "left").select(
        "doc_id",
        F.col("source").alias("repo"),
        F.concat(F.lit("https://tracker.example.org/"), "source", F.lit("/issues/"), "doc_id").alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        body.alias("body"),
    )


def parties(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers under common column names; only customers have a segment."""
    customer = table(spark, sf, "customer").toDF("key", "name", "nationkey", "acctbal", "segment")
    supplier = table(spark, sf, "supplier").toDF("key", "name", "nationkey", "acctbal")
    return customer, supplier


PARTY_SCHEMA = "key bigint, name string, nationkey int, acctbal double, segment string"


def corpus(spark: SparkSession, sf: str) -> SimilarityModel:
    """A model of the documents without lemmas."""
    return fit(
        table(spark, sf, "documents"), "text", ["source", "lang"], "doc_id", mode="none", n_best=N_BEST,
        label_names=["Source", "Lang"],
    )


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Sources and sinks


@query
def scan_dir(spark, sf):
    path = scratch_path(spark, "dir")
    customer, supplier = parties(spark, sf)
    customer.write.parquet(path)
    S.write_csv(supplier.withColumn("segment", F.lit(None).cast("string")), path, mode="append")
    return S.scan_dir(spark, path, PARTY_SCHEMA)


def _two_folders(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "prefix")
    orders = features.split_random(table(spark, sf, "orders"), "o_orderkey")
    orders.filter("split = 'train'").drop("split").write.parquet(f"{path}/train")
    orders.filter("split = 'validation'").drop("split").write.parquet(f"{path}/held/validation")
    return path


@query
def scan_prefix(spark, sf):
    return S.scan_prefix(spark, _two_folders(spark, sf))


@query
def scan_many(spark, sf):
    path = _two_folders(spark, sf)
    return S.scan_many(spark, [f"{path}/train", f"{path}/held/validation"])


@query
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    pages = table(spark, sf, "pages")
    S.write_csv(pages, path)
    return S.scan_csv(spark, path, pages.schema)


@query
def get_or_build(spark, sf):
    path = scratch_path(spark, "cache")

    def build():
        return weights.doc_freq(tokens.analyze(table(spark, sf, "documents")))

    S.get_or_build(spark, path, build)
    return S.get_or_build(spark, path, build)


@query
def scan_sampled(spark, sf):
    return S.scan_sampled(spark, f"{sf}/events.parquet", order_by="event_id").select(
        "event_id", "user_id", "event_type", "value", "props"
    )


@query
def write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    docs = table(spark, sf, "documents")
    S.write_csv(docs, path)
    return S.scan_csv(spark, path, docs.schema)


@query
def export(spark, sf):
    path = scratch_path(spark, "export")
    vectors = table(spark, sf, "embeddings")
    S.export(vectors, f"{path}/csv", "csv")
    S.export(vectors, f"{path}/parquet", "parquet")
    flat = S.scan_csv(spark, f"{path}/csv", "vec_id bigint, embedding string, label int")
    back = flat.select(
        "vec_id", "label", F.from_json("embedding", "array<float>").alias("csv_embedding")
    )
    whole = spark.read.parquet(f"{path}/parquet")
    return back.join(whole.select("vec_id", "embedding"), "vec_id").select(
        "vec_id",
        "label",
        F.size("embedding").cast("bigint").alias("length"),
        (F.col("embedding") == F.col("csv_embedding")).alias("same"),
    )


@query
def preview_chunks(spark, sf):
    return S.preview(table(spark, sf, "documents"), "doc_id")


@query
def save_model(spark, sf):
    """Vectors of a model that was written and loaded again."""
    model = corpus(spark, sf).save(scratch_path(spark, "model"))
    return model.vectors.select("doc_id", "term", "tf", r6("w"))


@query
def load_model(spark, sf):
    """The benchmark answered by a model read from its tables."""
    path = scratch_path(spark, "model")
    corpus(spark, sf).save(path)
    return plan_model.load_model(spark, path).predict(benchmark(spark, sf))


@query
def write_labelled_csv(spark, sf):
    path = scratch_path(spark, "labelled")
    S.write_labelled_csv(table(spark, sf, "part"), path, "p_retailprice", ["p_partkey", "p_size"])
    return spark.read.schema("p_retailprice double, p_partkey bigint, p_size int").csv(path)


@query
def write_split(spark, sf):
    path = scratch_path(spark, "split")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    S.write_split(features.split_random(orders, "o_orderkey"), path)
    return S.scan_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double, split string")


# Projections, filters, casts, unions


@query
def corpus_labels(spark, sf):
    df = tables.corpus_labels(issues(spark, sf), "body", ["url", "title"])
    return df.select("corpus", F.col("label.url").alias("url"), F.col("label.title").alias("title"))


@query
def query_eq(spark, sf):
    return tables.query_eq(
        table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="5-LOW"
    ).select("o_orderkey", "o_custkey", "o_totalprice")


@query
def infer_and_cast(spark, sf):
    items = table(spark, sf, "lineitem")
    text = items.select([F.col(c).cast("string").alias(c) for c in items.columns])
    return tables.infer_and_cast(text)


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a ticket table of texts, whose numbers and flags don't all fit their types."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat_ws("-", F.lit("order"), "o_custkey").alias("title"),
        F.col("o_custkey").cast("string").alias("databaseId"),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("#"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string")).alias("number"),
        F.when(F.col("o_orderstatus") == "P", "partly").otherwise(F.when(F.col("o_orderstatus") == "F", "true").otherwise("false")).alias("closed"),
        F.col("o_orderpriority").alias("priority"),
    )


@query
def conform(spark, sf):
    """The declared ticket columns, all thirty."""
    return tables.conform(tickets(spark, sf))


@query
def cast_rejects(spark, sf):
    """Each value of the ticket table that its declared type refuses, with its row."""
    return tables.cast_rejects(tickets(spark, sf), tables.TICKET_SCHEMA, ["id"])


@query
def drop_cols(spark, sf):
    return tables.drop_cols(table(spark, sf, "customer"), "c_name", "c_mktsegment")


@query
def label_first(spark, sf):
    return tables.label_first(table(spark, sf, "part"), "p_retailprice")


@query
def title_body(spark, sf):
    return issues(spark, sf).select(
        "doc_id", T.title_body(F.col("title"), F.col("body")).alias("title_body")
    )


@query
def scale_const(spark, sf):
    return tables.scale_const(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"
    )


@query
def concat_rows(spark, sf):
    return tables.concat_rows(parties(spark, sf))


@query
def concat_dedupe(spark, sf):
    return tables.concat_dedupe(
        [table(spark, sf, t).select("text") for t in ("documents", "conversations", "benchmark")], dedupe=True
    )


@query
def distinct_values(spark, sf):
    return tables.distinct_values(table(spark, sf, "documents"), "source")


@query
def vocab_size(spark, sf):
    return weights.vocab_size(corpus(spark, sf).vocab).select("terms")


# Cleaning


def _cleaned(fn):
    def run(spark, sf):
        return issues(spark, sf).select("doc_id", fn(F.col("body")).alias("body"))

    return run


QUERIES["strip_code"] = _cleaned(T.strip_code)
QUERIES["strip_urls"] = _cleaned(T.strip_urls)
QUERIES["strip_markdown"] = _cleaned(T.strip_markdown)


@query
def drop_boilerplate(spark, sf):
    return cleaning.drop_boilerplate(issues(spark, sf), "body", "repo", MIN_SHARE).select("doc_id", "body")


@query
def concat_comments(spark, sf):
    return cleaning.concat_comments(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query
def clean_issue(spark, sf):
    return cleaning.clean_issue(issues(spark, sf), min_share=MIN_SHARE)


# Tokens


def _tokenized(fn):
    def run(spark, sf):
        return joined(spread(table(spark, sf, "documents").select("doc_id", "text")), fn(F.col("text")))

    return run


QUERIES["tokens_alpha"] = _tokenized(T.tokens_alpha)
QUERIES["tokens_word"] = _tokenized(T.tokens_word)
QUERIES["tokens_punct"] = _tokenized(T.tokens_punct)
QUERIES["tokens_standard"] = _tokenized(T.tokens_standard)
QUERIES["stop_words"] = _tokenized(lambda c: T.drop_stop_words(T.tokens_word(c)))
QUERIES["min_len"] = _tokenized(lambda c: T.min_len(T.tokens_word(c)))


@query
def pos_filter(spark, sf):
    rows = tokens.token_rows(table(spark, sf, "documents"), "text", T.tokens_alpha)
    counts = rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return tokens.pos_filter(counts, materialize(tokens.lexicon_from(counts), "lexicon"))


@query
def lemma(spark, sf):
    rows = tokens.token_rows(table(spark, sf, "documents"), "text", T.tokens_alpha)
    lexicon = tokens.lexicon_from(rows)
    return tokens.lemma_map(lexicon.filter("pos in ('N', 'V')"), lexicon)


def _analyzed(mode: str):
    def run(spark, sf):
        return tokens.analyze(table(spark, sf, "documents"), mode=mode)

    return run


QUERIES["analyzer_default"] = _analyzed("default")
QUERIES["analyzer_custom"] = _analyzed("custom")
QUERIES["analyzer_none"] = _analyzed("none")


def _best_pairs(spark, sf, model: SimilarityModel) -> DataFrame:
    """Each query with its best document."""
    queries = benchmark(spark, sf)
    best = search.top_n(model.scores(queries), 1).select("query_id", "doc_id")
    return queries.join(best, "query_id")


@query
def common_words(spark, sf):
    pairs = _best_pairs(spark, sf, corpus(spark, sf)).withColumnRenamed("text", "query")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    words = T.common_words(
        T.drop_stop_words(T.tokens_word(F.col("query"))), T.drop_stop_words(T.tokens_word(F.col("text")))
    )
    return pairs.join(docs, "doc_id").select("query_id", "doc_id", F.array_join(words, " ").alias("words"))


# Weights


@query
def term_counts(spark, sf):
    return tokens.analyze(table(spark, sf, "documents"))


@query
def doc_freq(spark, sf):
    return corpus(spark, sf).vocab.select("term", "df")


@query
def idf(spark, sf):
    return corpus(spark, sf).vocab.select("term", "df", r6("idf"))


@query
def tfidf_l2(spark, sf):
    return corpus(spark, sf).vectors.select("doc_id", "term", "tf", r6("w"))


@query
def transform(spark, sf):
    return corpus(spark, sf).transform(benchmark(spark, sf)).select("query_id", "term", "tf", r6("w"))


@query
def count_vectorize(spark, sf):
    return weights.count_vectorize(table(spark, sf, "documents"))


@query
def idf_min_df(spark, sf):
    docs = table(spark, sf, "documents")
    counts = weights.count_vectorize(docs)
    return weights.idf_min_df(counts, weights.corpus_size(docs)).select("doc_id", "term", "tf", r6("w"))


@query
def vector_col(spark, sf):
    """Per vocabulary term: documents with a weight, and the sum of weights, read off the vector column."""
    docs = table(spark, sf, "documents")
    model = flow.fit_vectors(docs, "text")
    vectors = flow.vector_col(docs, model)
    metrics = Summarizer.metrics("numNonZeros", "sum").summary(F.col("vectorRepresentation"))
    sums = vectors.agg(metrics.alias("m")).select(
        F.arrays_zip(
            vector_to_array("m.numNonZeros").alias("docs"), vector_to_array("m.sum").alias("total")
        ).alias("z")
    )
    vocabulary = spark.createDataFrame(list(enumerate(model.stages[1].vocabulary)), "pos int, term string")
    return (
        sums.select(F.posexplode("z").alias("pos", "z"))
        .join(vocabulary, "pos")
        .select("term", F.col("z.docs").cast("bigint").alias("docs"), F.round("z.total", 4).alias("total"))
    )


def _fit(spark, sf):
    """Vocabulary of a model fitted with lemmas and parts of speech, written and loaded again."""
    docs = table(spark, sf, "documents")
    model = fit(docs, "text", ["source"], "doc_id", mode="custom")
    return model.save(scratch_path(spark, "model")).vocab.select("term", "df", r6("idf"))


QUERIES["fit"] = _fit


# Search


@query
def dot_sparse(spark, sf):
    return corpus(spark, sf).scores(benchmark(spark, sf)).select("query_id", "doc_id", r6("score"))


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """``(query_id, vec)``: the mean embedding of each label."""
    coords = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = coords.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        F.col("label").cast("bigint").alias("query_id"), F.col("v.x").alias("vec")
    )


def _blank(c: str, below: float):
    """Coordinates close to zero taken as missing."""
    return F.transform(
        c, lambda x: F.when(F.abs(x.cast("double")) < below, F.lit(float("nan"))).otherwise(x.cast("double"))
    )


@query
def dot_dense(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return dense.dense_top_n(vectors, centroids(spark, sf), N_BEST)


@query
def dense_labels(spark, sf):
    """The best vectors of each centroid and their labels."""
    rows = table(spark, sf, "embeddings")
    vectors = rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    labels = rows.select(F.col("vec_id").alias("doc_id"), "label")
    return dense.dense_predict(vectors, labels, centroids(spark, sf), N_BEST)


@query
def cosine_nan(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), _blank("embedding", 0.02).alias("vec")
    )
    queries = centroids(spark, sf).select("query_id", _blank("vec", 0.005).alias("vec"))
    return dense.dense_top_n(vectors, queries, N_BEST, "cosine_nan")


@query
def top_n(spark, sf):
    return search.top_n(corpus(spark, sf).scores(benchmark(spark, sf)), N_BEST)


@query
def label_lookup(spark, sf):
    queries = benchmark(spark, sf)
    best = search.top_n(corpus(spark, sf).scores(queries), N_BEST)
    labels = table(spark, sf, "labels")
    return search.label_lookup(best, labels, search.is_small(queries)).select(
        "query_id", "rank", "doc_id", "quality", "toxic"
    )


@query
def pad_zero(spark, sf):
    """Part names as queries: few of their words are known, so the lists are filled up."""
    queries = (
        table(spark, sf, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("query_id"))
    )
    return corpus(spark, sf).predict(queries, pad=True).select("query_id", "rank", "doc_id", "score")


@query
def predict(spark, sf):
    return corpus(spark, sf).predict(benchmark(spark, sf))


def _predict_lemmas(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """The benchmark against a stored model with lemmas."""
    model = fit(table(spark, sf, "documents"), "text", ["source", "lang"], "doc_id", mode=mode, n_best=N_BEST)
    return model.save(scratch_path(spark, "model")).predict(benchmark(spark, sf))


@query
def predict_custom(spark, sf):
    return _predict_lemmas(spark, sf, "custom")


@query
def predict_default(spark, sf):
    return _predict_lemmas(spark, sf, "default")


@query
def predict_obj(spark, sf):
    objects = corpus(spark, sf).predict_obj(benchmark(spark, sf))
    return objects.select(
        "query_id", F.col("obj.Text").alias("text"), F.posexplode("obj.Similar").alias("pos", "s")
    ).select(
        "query_id", "text", "pos", F.col("s.Source").alias("source"), F.col("s.Lang").alias("lang"),
        F.col("s.Score").alias("score"),
    )


@query
def inspect_doc(spark, sf):
    return inspect.inspect_doc(corpus(spark, sf).vectors)


@query
def get_weights(spark, sf):
    model = corpus(spark, sf)
    docs = table(spark, sf, "documents")
    return model.get_weights(_best_pairs(spark, sf, model), docs).select(
        "query_id", "doc_id", "pos", "term", r6("weight")
    )


@query
def near_dups(spark, sf):
    return duplicates.near_dups(table(spark, sf, "documents"), threshold=NEAR)


@query
def batch_vs_catalog(spark, sf):
    model = corpus(spark, sf)
    new = benchmark(spark, sf)
    vectors = model.transform(new).withColumnRenamed("query_id", "doc_id")
    return duplicates.batch_vs_catalog(vectors, model.vectors, search.is_small(new, "text"), N_BEST).select(
        "query_id", "side", "doc_id", "score", "rank"
    )


@query
def score_gap(spark, sf):
    return search.score_gap(search.top_n(corpus(spark, sf).scores(benchmark(spark, sf)), N_BEST))


@query
def cross_group_match(spark, sf):
    """Best matches outside the source of a query's best match."""
    queries = benchmark(spark, sf)
    small = search.is_small(queries, "text")
    groups = table(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"))
    best = search.best_per_group(corpus(spark, sf).scores(queries), groups, N_BEST)
    return search.cross_group(best, search.home_groups(best), small, N_BEST)


# Feature tables


@query
def split_positional(spark, sf):
    return features.split_positional(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query
def split_random(spark, sf):
    return features.split_random(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query
def standardize(spark, sf):
    """Fitted on the training rows, applied to all."""
    part = features.split_positional(table(spark, sf, "part"), "p_partkey")
    scaled = features.standardize(part, ["p_size", "p_retailprice"], part.filter("split = 'train'"))
    return scaled.select("p_partkey", "split", r6("p_size"), r6("p_retailprice"))


@query
def kfold(spark, sf):
    folds = features.kfold(table(spark, sf, "orders"), "o_orderkey")
    return folds.groupBy("fold").agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_price")
    )


@query
def error_gate(spark, sf):
    labels = table(spark, sf, "labels").withColumn("predicted", 1 - F.col("toxic"))
    return features.error_gate(labels, "quality", "predicted").withColumn("error", F.round("error", 6))


# Streams


@query
def parse_requests(spark, sf):
    """Well-formed bodies from the benchmark, bodies without the field from events, raw text from documents."""
    good = benchmark(spark, sf).select(
        F.lit("benchmark").alias("kind"), F.col("query_id").alias("id"),
        F.to_json(F.struct(F.col("text").alias("data"))).alias("body"),
    )
    other = table(spark, sf, "events").select(F.lit("events").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("body"))
    bad = table(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return serving.parse_requests(tables.concat_rows([good, other, bad])).select("kind", "id", "text", "ok")


@query
def stream_score(spark, sf):
    """The benchmark as a stream of requests against a stored model."""
    model = corpus(spark, sf).save(scratch_path(spark, "model"))
    out = scratch_path(spark, "scored")
    items = serving.stream_table(spark, sf, "benchmark", "item_id bigint, text string").select(F.col("item_id").alias("query_id"), "text")
    serving.stream_score(items, model, out, scratch_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).drop("run_id", "batch_id")


@query
def catalog_append(spark, sf):
    """Documents pulled into an empty catalog, then the refreshed vocabulary."""
    catalog = scratch_path(spark, "catalog")
    docs = serving.stream_table(spark, sf, "documents", table(spark, sf, "documents").schema).select("doc_id", "text")
    serving.catalog_append(docs, catalog, scratch_path(spark, "checkpoint")).awaitTermination()
    return serving.refresh_vocab(spark, catalog).select("term", "df", r6("idf"))


@query
def catalog_search(spark, sf):
    """The benchmark against a model over a catalog that took the documents in from a stream."""
    catalog = scratch_path(spark, "catalog")
    docs = serving.stream_table(spark, sf, "documents", table(spark, sf, "documents").schema).select("doc_id", "text")
    serving.catalog_append(docs, catalog, scratch_path(spark, "checkpoint")).awaitTermination()
    labels = table(spark, sf, "documents").select("doc_id", "source", "lang")
    found = serving.catalog_model(spark, catalog, labels).predict(benchmark(spark, sf))
    return found.select("query_id", "rank", "doc_id", "score", "source", "lang")


@query
def feedback_counts(spark, sf):
    """All days, those still open to late votes included."""
    events = serving.stream_table(spark, sf, "events", table(spark, sf, "events").schema)
    out = scratch_path(spark, "votes")
    counts = serving.feedback_counts(events, "ts", "event_type", F.col("value"))
    serving.run_updates(counts, out, scratch_path(spark, "checkpoint")).awaitTermination()
    found = serving.latest_updates(spark.read.parquet(out), ["window_start", "window_end", "event_type"])
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "votes", F.round("total", 2).alias("total")
    )


@query
def feedback_late(spark, sf):
    """Votes by day from a stream of several batches, late ones counted apart and added again."""
    events = table(spark, sf, "events")
    parts = scratch_path(spark, "events")
    events.repartition(4, "event_type", "ts").write.parquet(parts)
    stream = serving.stream_files(spark, parts, events.schema, maxFilesPerTrigger=1)
    out = scratch_path(spark, "votes")
    serving.count_votes(stream, "ts", "event_type", F.col("value"), out, scratch_path(spark, "checkpoint")).awaitTermination()
    return serving.votes(spark, out, "event_type").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "votes", F.round("total", 2).alias("total")
    )
