"""Sparse search: scores by an inverted-index join, best matches, their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.operators.tokens import common_terms, term_bucket, unpack
from nearkin.session import materialize

# A query side is broadcast only below these bounds, which hold its term rows to some tens of megabytes.
BROADCAST_ROWS = 100_000
BROADCAST_TEXT_BYTES = 4 * 1024 * 1024
# Postings of one term that share a join key once both sides are shuffled.
POSTINGS_PER_KEY = 100_000
DECIMALS = 6
# Documents of a block of a stored index, and the blocks of a query that are scored first.
BLOCK_DOCS = 16
FIRST_BLOCKS = 8
# Below this number of matching postings a search scores all of them; a cut would cost more than it saves.
DIRECT_POSTINGS = 20_000_000


def is_small(df: DataFrame, text: str | None = None, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a query table may be broadcast: its rows and the bytes of its text, summed up where they lie.

    A text of b bytes holds fewer than b/3 distinct terms plus separators, so the bytes bound every
    term table derived from it.
    """
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    row = df.agg(F.count("*").alias("n"), size.alias("b")).first()
    return row["n"] <= rows and (row["b"] or 0) <= BROADCAST_TEXT_BYTES


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def dot_sparse(
    vectors: DataFrame,
    query_vectors: DataFrame,
    small: bool,
    keep: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """``(query_id, doc_id, score)`` for every pair that shares a term.

    ``small`` states that the query side passed ``is_small``. It is then broadcast and each document is
    scored where its vector lies: a table partitioned by doc_id is not shuffled again. Otherwise both sides are
    shuffled on the term, and a term in many documents is spread over as many keys as its document
    frequency asks for. ``keep`` names columns of ``vectors`` that depend on doc_id alone. Vectors stored in
    ``buckets`` folders are read only in those of the query terms.
    """
    q = query_vectors.select("query_id", "term", "df", F.col("w").alias("qw"))
    on = ["term"]
    if buckets:
        q, on = q.withColumn("bucket", term_bucket(F.col("term"), buckets)), ["bucket", "term"]
    if small:
        pairs = vectors.join(F.broadcast(q.drop("df")), on)
    else:
        salts = F.greatest(F.ceil(F.col("df") / POSTINGS_PER_KEY), F.lit(1)).cast("int")
        docs = vectors.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("df")
        pairs = docs.join(q, [*on, "salt"])
    return pairs.groupBy("query_id", "doc_id", *keep).agg(
        F.sum(F.col("w") * F.col("qw")).alias("score")
    )


def top_n(
    scores: DataFrame, n: int = 10, by: Sequence[str] = ("query_id",), id_col: str = "doc_id"
) -> DataFrame:
    """The ``n`` best rows per query with ``rank`` from 1; ties go to the lower id.

    Spark drops rows beyond rank ``n`` before the shuffle, so a query that matches everything stays cheap.
    """
    score = F.round("score", DECIMALS)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), id_col)
    return (
        scores.withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def doc_blocks(vectors: DataFrame) -> DataFrame:
    """``(doc_id, block)``: documents in small blocks, those with the same heaviest terms next to each other.

    Numbers follow a distributed sort; they are fixed by writing the table.
    """
    heaviest = vectors.groupBy("doc_id").agg(F.max(F.struct("w", "term")).alias("top"))
    laid = heaviest.select("doc_id", F.col("top.term").alias("term"), F.col("top.w").alias("w")).orderBy("term", "w", "doc_id")
    return materialize(laid.select("doc_id", F.floor(F.monotonically_increasing_id() / BLOCK_DOCS).alias("block")), "blocks")


def block_vectors(bags: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, df, w, block)``: vectors as of ``weigh``, with blocks as of ``doc_blocks``, from ``bags(doc_id, terms, tfs)``.

    The most frequent terms are weighed where the bags lie, so that only the rows of other terms are moved to get their
    frequency. Norms are sums of both; with the blocks they are joined to whole bags.
    """
    common, rest = common_terms(vocab)

    def weighed(rows: DataFrame, terms: DataFrame, *columns: str) -> DataFrame:
        return rows.join(terms, "term").select("doc_id", "term", "tf", "df", (F.col("tf") * F.col("idf")).alias("raw"), *columns)

    rows = unpack(bags, "doc_id")
    parts = weighed(rows, F.broadcast(common))
    if rest is not None:
        rare = materialize(weighed(rows.join(F.broadcast(common.select("term")), "term", "left_anti"), rest), "rare")
        parts = parts.unionByName(rare)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")))
    sums = parts.groupBy("doc_id").agg(norm.alias("norm"), F.max(F.struct("raw", "term")).alias("top"))
    laid = sums.select(
        "doc_id", "norm", F.col("top.term").alias("term"), (F.col("top.raw") / F.col("norm")).alias("w")
    ).orderBy("term", "w", "doc_id")
    block = F.floor(F.monotonically_increasing_id() / BLOCK_DOCS).alias("block")
    docs = materialize(laid.select("doc_id", "norm", block), "blocks")
    placed = materialize(bags.join(docs, "doc_id"), "placed")
    known = weighed(unpack(placed, "doc_id", "norm", "block"), F.broadcast(common), "norm", "block")
    if rest is not None:
        known = known.unionByName(materialize(rare.join(docs, "doc_id"), "rare"))
    return known.select("doc_id", "term", "tf", "df", (F.col("raw") / F.col("norm")).alias("w"), "block")


def block_weights(vectors: DataFrame, by: Sequence[str], layout: Sequence[str]) -> DataFrame:
    """``vectors(term, block, w, …)`` with ``top``: whether a row's is the largest weight of its term within its block; one row of the two.

    The table is partitioned by the columns ``by`` and sorted by those of ``layout``; all of them follow from term and block, so
    no row moves for this.
    """
    own = Window.partitionBy(*dict.fromkeys([*layout, "term", "block", *by])).orderBy(F.desc("w"))
    return vectors.withColumn("top", F.row_number().over(own) == 1)


def top_blocks(
    vectors: DataFrame, blocks: DataFrame, query_vectors: DataFrame, small: bool, n: int = 10, buckets: int | None = None
) -> DataFrame:
    """``top_n`` of ``dot_sparse``, leaving out blocks of documents that cannot hold one of the ``n`` best.

    A query's weights times the largest ones of a block bound every score in it. The blocks with the highest bounds are
    scored first; the ``n``-th score found there is one that the ``n`` best reach, so blocks bounded below it
    are skipped. Pairs of a query and a document are made and shuffled for the other blocks only.
    ``vectors`` carry their ``block``; ``blocks(term, block, most)`` are the top rows of ``block_weights``. Both may lie in ``buckets``, and the query side
    should be a table.
    """
    q = query_vectors.select("query_id", "term", F.col("w").alias("qw"))
    on = ["term"]
    if buckets:
        q, on = q.withColumn("bucket", term_bucket(F.col("term"), buckets)), ["bucket", "term"]
    met = blocks.join(_maybe_broadcast(q, small), on)
    bounds = materialize(met.groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("qw")).alias("bound")), "bounds")

    def scored(kept: DataFrame) -> DataFrame:
        kept = materialize(kept.select("query_id", "block"), "kept")
        if small and kept.count() <= BROADCAST_ROWS:
            pairs = vectors.join(F.broadcast(q), on).join(F.broadcast(kept), ["query_id", "block"], "left_semi")
        else:
            pairs = vectors.join(q.join(kept, "query_id"), [*on, "block"])
        scores = pairs.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
        return top_n(scores, n)

    highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = scored(bounds.withColumn("r", F.row_number().over(highest)).filter(F.col("r") <= FIRST_BLOCKS))
    # Scores are compared rounded, hence the slack; a query with fewer matches so far has no floor.
    least = F.when(F.count("*") >= n, F.min("score") - 2 * 10.0**-DECIMALS)
    floors = first.groupBy("query_id").agg(least.alias("floor"))
    return scored(bounds.join(floors, "query_id", "left").filter(F.col("bound") >= F.coalesce("floor", F.lit(0.0))))


def label_lookup(top: DataFrame, labels: DataFrame, small: bool) -> DataFrame:
    """Attach label columns by doc_id; matches without a label keep nulls.

    ``small`` states that the matched ids are few enough to be broadcast: the labels are then narrowed to them where
    they lie. Otherwise both sides are shuffled, and Spark splits a document that many queries match.
    """
    if not small:
        return top.join(labels, "doc_id", "left")
    hit = labels.join(F.broadcast(top.select("doc_id").distinct()), "doc_id", "left_semi")
    return top.join(hit, "doc_id", "left")


def pad_zero(top: DataFrame, queries: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    """Fill each query up to ``min(n, N)`` rows with score-0 documents, lowest ids first.

    Among the ``n`` lowest ids at least ``n - found`` are not yet found, so those ids suffice; they travel as
    one short array.
    """
    ids = docs.select("doc_id").orderBy("doc_id").limit(n)
    lowest = ids.agg(F.sort_array(F.collect_list("doc_id"))).scalar()
    found = top.groupBy("query_id").agg(
        F.collect_list("doc_id").alias("ids"), F.count("*").alias("found")
    )
    fill = (
        queries.select("query_id")
        .join(found, "query_id", "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .withColumn(
            "missing", F.when(F.col("ids").isNull(), lowest).otherwise(F.array_except(lowest, "ids"))
        )
        .select("query_id", "found", F.posexplode("missing").alias("pos", "doc_id"))
        .withColumn("rank", (F.col("found") + F.col("pos") + 1).cast("int"))
        .filter(F.col("rank") <= n)
        .select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank")
    )
    return top.select("query_id", "doc_id", "score", "rank").unionByName(fill)


def as_objects(
    top: DataFrame, queries: DataFrame, label_names: Sequence[str], label_cols: Sequence[str]
) -> DataFrame:
    """``(query_id, obj)`` with ``obj = {Text, Similar: [{label…, Score}]}``, one row per query.

    A query's list holds its ranked matches only, so its length is the ``n`` of the search.
    """
    if not label_names:
        raise ValueError("label names are needed for the output object")
    if len(label_names) != len(label_cols):
        raise ValueError("label names and label columns differ in number")
    entry = F.struct(
        *[F.col(c).alias(name) for name, c in zip(label_names, label_cols)], F.col("score").alias("Score")
    )
    lists = top.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("ranked")
    )
    similar = F.transform("ranked", lambda r: r["entry"])
    return queries.join(lists, "query_id", "left").select(
        "query_id",
        F.struct(
            F.col("text").alias("Text"), F.when(similar.isNotNull(), similar).otherwise(F.array()).alias("Similar")
        ).alias("obj"),
    )


def score_gap(top: DataFrame) -> DataFrame:
    """Per query: best score, the next one, the mean of the rest and how far the best stands out."""
    per_query = top.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"),
        F.avg(F.when(F.col("rank") >= 2, F.col("score"))).alias("rest_avg"),
    )
    return per_query.select(
        "query_id",
        "best",
        "next",
        F.round("rest_avg", DECIMALS).alias("rest_avg"),
        F.round(F.col("best") / F.col("next"), DECIMALS).alias("ratio_next"),
        F.round(F.col("best") / F.col("rest_avg"), DECIMALS).alias("ratio_rest"),
    )


def best_per_group(scores: DataFrame, groups: DataFrame, n: int = 10) -> DataFrame:
    """``(query_id, doc_id, score, grp)``: the ``n`` best of each query in each group, from ``groups(doc_id, grp)``.

    Whatever groups a search is later restricted to, its ``n`` best are among these.
    """
    return top_n(scores.join(groups, "doc_id"), n, by=("query_id", "grp")).drop("rank")


def home_groups(best: DataFrame) -> DataFrame:
    """``(query_id, own)``: the group of each query's best match."""
    return top_n(best, 1).select("query_id", F.col("grp").alias("own"))


def cross_group(best: DataFrame, query_groups: DataFrame, small: bool, n: int = 10) -> DataFrame:
    """Best matches outside a query's own group, from ``best_per_group`` and ``query_groups(query_id, own)``.

    Queries without a group are left out.
    """
    own = _maybe_broadcast(query_groups, small)
    return top_n(best.join(own, "query_id").filter(F.col("grp") != F.col("own")), n)
