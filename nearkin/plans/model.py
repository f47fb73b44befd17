"""The fitted model: a handful of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from nearkin.functions.wordlists import ENGLISH_STOP_WORDS
from nearkin.operators import inspect, search, tokens, weights
from nearkin.session import free_shuffles, materialize, passing
from nearkin.sources import snapshots

Texts = DataFrame | str | Sequence[str]
PARAMS = (
    "mode string, n_best int, label_names array<string>, stop_words array<string>, has_lexicon boolean, "
    "has_exceptions boolean, buckets int, has_blocks boolean"
)


@dataclass(frozen=True)
class SimilarityModel:
    """Vocabulary ``(term, df, idf)``, vectors ``(doc_id, term, tf, df, w)``, labels ``(doc_id, …)``.

    Modes with lemmas also keep the lexicon ``(token, pos)`` they were fitted with, each token once, and irregular forms
    ``(token, pos, lemma)`` if there are any. A model that was just
    fitted knows its raw counts, ``bags(doc_id, terms, tfs)`` or as rows ``(doc_id, term, tf)``, and weighs them on demand; one that was loaded knows in how
    many term buckets its vocabulary and vectors are stored, and the largest weight of each term in each block of
    documents, ``blocks(term, block, most)``.
    """

    vocab: DataFrame
    vectors: DataFrame
    labels: DataFrame
    mode: str = "default"
    n_best: int = 10
    label_names: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = tuple(ENGLISH_STOP_WORDS)
    lexicon: DataFrame | None = None
    exceptions: DataFrame | None = None
    counts: DataFrame | None = None
    bags: DataFrame | None = None
    buckets: int | None = None
    blocks: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.vocab.sparkSession

    @property
    def label_cols(self) -> list[str]:
        return [c for c in self.labels.columns if c != "doc_id"]

    def as_frame(self, texts: Texts, id_col: str = "query_id") -> DataFrame:
        """``(id, text)`` from a DataFrame of that shape, one string or several."""
        if isinstance(texts, DataFrame):
            return texts.select(id_col, "text")
        rows = [texts] if isinstance(texts, str) else list(texts)
        return self.spark.createDataFrame(list(enumerate(rows)), f"{id_col} bigint, text string")

    def _small(self, texts: Texts, frame: DataFrame) -> bool:
        """Whether the texts may be broadcast; those at hand are measured without a job."""
        if isinstance(texts, DataFrame):
            return search.is_small(frame, "text")
        texts = [texts] if isinstance(texts, str) else list(texts)
        return len(texts) <= search.BROADCAST_ROWS and sum(len((t or "").encode()) for t in texts) <= search.BROADCAST_TEXT_BYTES

    def transform(self, texts: Texts, id_col: str = "query_id") -> DataFrame:
        """Vectors of new texts under the stored vocabulary; unknown terms are ignored."""
        frame = self.as_frame(texts, id_col)
        return self._transform(frame, id_col, self._small(texts, frame))

    def _transform(self, frame: DataFrame, id_col: str, small: bool) -> DataFrame:
        counts = tokens.analyze(
            frame, "text", id_col, self.mode, self.lexicon, self.stop_words, self.exceptions, small=small, buckets=self.buckets
        )
        return weights.weigh(counts, self.vocab, id_col, small, self.buckets)

    def scores(self, queries: Texts) -> DataFrame:
        """``(query_id, doc_id, score)`` for every pair that shares a term."""
        frame = self.as_frame(queries)
        small = self._small(queries, frame)
        return search.dot_sparse(
            self.vectors, self._transform(frame, "query_id", small), small, buckets=self.buckets
        )

    def _best(self, frame: DataFrame, small: bool, n: int) -> DataFrame:
        """The ``n`` best of each query; of a stored model only blocks that may hold them are scored."""
        vectors = self._transform(frame, "query_id", small)
        if self.blocks is not None:
            vectors = materialize(vectors, "asked")
            if (vectors.agg(F.sum("df")).first()[0] or 0) > search.DIRECT_POSTINGS:
                return search.top_blocks(self.vectors, self.blocks, vectors, small, n, self.buckets)
        return search.top_n(search.dot_sparse(self.vectors, vectors, small, buckets=self.buckets), n)

    def predict(self, queries: Texts, n_best: int | None = None, pad: bool = False) -> DataFrame:
        """``(query_id, rank, doc_id, score, label…)``: the best documents of each query.

        ``pad`` fills each query up to ``n_best`` rows with score-0 documents.
        """
        n = n_best or self.n_best
        frame = self.as_frame(queries)
        small = self._small(queries, frame)
        top = self._best(frame, small, n)
        if pad:
            top = search.pad_zero(top, frame, self.labels, n)
        few = small and (isinstance(queries, str) or search.is_small(frame, rows=search.BROADCAST_ROWS // n))
        if few:
            # The matches are met twice below; written, they are scored once.
            top = materialize(top, "top")
        return search.label_lookup(top, self.labels, few).select(
            "query_id", "rank", "doc_id", "score", *self.label_cols
        )

    def predict_obj(self, queries: Texts, n_best: int | None = None, pad: bool = False) -> DataFrame:
        """``(query_id, obj)`` with ``obj = {Text, Similar: [{label…, Score}]}``."""
        frame = self.as_frame(queries)
        return search.as_objects(
            self.predict(frame, n_best, pad), frame, self.label_names, self.label_cols
        )

    def inspect_doc(self, docs: Texts, n_top: int = 10) -> DataFrame:
        """``(doc_id, rank, term, weight)``: the heaviest terms of each text."""
        return inspect.inspect_doc(self.transform(docs, "doc_id"), n_top)

    def get_weights(self, query: Texts, docs: Texts, lower: bool = False) -> DataFrame:
        """The weight of each query word in its document.

        ``query`` has columns ``(query_id, doc_id, text)`` when a DataFrame; a single string is asked of the
        single document. Query words are tokenized and lemmatized only: case is kept unless ``lower`` is set
        and stop words stay.
        """
        docs = self.as_frame(docs, "doc_id")
        if not isinstance(query, DataFrame):
            query = self.as_frame(query).withColumn("doc_id", F.lit(0).cast("bigint"))
        # The pairs are met several times below, and may come from a search.
        query = materialize(query.select("query_id", "doc_id", "text"), "pairs")
        cut = tokens.TOKENIZERS[self.mode](F.col("text"), lower=lower)
        words = query.select("query_id", "doc_id", F.posexplode(cut).alias("pos", "token"))
        small = search.is_small(query, "text")
        if self.mode == "none":
            words = words.withColumnRenamed("token", "term")
        else:
            lexicon = tokens.narrow_lexicon(self.lexicon, words, self.buckets) if small else self.lexicon
            words = words.join(tokens.term_map(words, self.mode, lexicon, (), self.exceptions), "token").drop("token")
        asked = query.select("doc_id").distinct()
        docs = docs.join(F.broadcast(asked) if small else asked, "doc_id", "left_semi")
        return inspect.get_weights(words, self.transform(docs, "doc_id"), self.vocab, small)

    def save(self, path: str, mode: str = "errorifexists") -> SimilarityModel:
        """Write the tables and return the model that reads them.

        Vocabulary and vectors are laid out by term bucket and sorted by term, which lets a search read only the
        buckets of its terms. Tables go to a folder of their own, which becomes the model at the end: with ``overwrite``
        a model that is there stays readable until then, and also if the save fails.
        """
        if mode not in ("errorifexists", "overwrite"):
            raise ValueError("mode is errorifexists or overwrite")
        if mode == "errorifexists" and snapshots.current(self.spark, path) is not None:
            raise FileExistsError(f"there is a model at {path}")
        base = f"{path.rstrip('/')}/{snapshots.new_folder('model')}"
        self.labels.write.parquet(f"{base}/labels")
        if self.exceptions is not None:
            self.exceptions.write.parquet(f"{base}/exceptions")
        size = self.vocab.agg(F.sum("df").alias("postings"), F.count("*").alias("terms"), F.max("df").alias("most")).first()
        buckets = weights.bucket_count(size["postings"] or 0)
        with passing(self.spark):
            self._lay_out(base, size, buckets)
        if self.lexicon is not None:
            # As with the vocabulary, a search reads only the folders of its words and their base forms.
            bucket = weights.term_bucket(F.col("token"), buckets).alias("bucket")
            (
                self.lexicon.select("token", "pos", bucket)
                .repartition(buckets, "bucket")
                .sortWithinPartitions("bucket", "token")
                .write.partitionBy("bucket")
                .parquet(f"{base}/lexicon")
            )
        params = (
            self.mode, self.n_best, list(self.label_names), list(self.stop_words), self.lexicon is not None,
            self.exceptions is not None, buckets, False,
        )
        self.spark.createDataFrame([params], PARAMS).coalesce(1).write.parquet(f"{base}/params")
        snapshots.publish(self.spark, path, [base])
        return load_model(self.spark, path)

    def _lay_out(self, base: str, size: Row, buckets: int) -> None:
        """Write vocabulary and vectors, in rounds of some of the buckets where there are many postings.

        The exchange of a round is of no use once it is written, so the disk it needs doesn't grow with the model.
        """
        postings, per_file = size["postings"] or 0, weights.POSTINGS_PER_FILE
        if self.bags is not None or self.counts is not None:
            bags = self.bags if self.bags is not None else materialize(tokens.pack(self.counts), "bags")
            vectors = search.block_vectors(bags, self.vocab)
        else:
            vectors = self.vectors.drop("block").join(search.doc_blocks(self.vectors), "doc_id")
        # A term in many documents is spread over as many files of its folder as its postings fill, each block in one of them.
        salt = F.pmod(F.xxhash64("block"), F.ceil(F.col("df") / per_file).cast("int"))
        hot = max(weights.files_per_bucket(postings, buckets), min(weights.MAX_FILES, -(-(size["most"] or 1) // per_file)))
        hot_part = F.when(F.col("df") > per_file, F.pmod(F.xxhash64("term", salt), F.lit(hot)))
        for name, table, columns, rows in (
            ("vocab", self.vocab, ["term", "df", "idf"], size["terms"]),
            ("vectors", vectors, ["doc_id", "term", "tf", "df", "w", "block"], postings),
        ):
            part = F.pmod(F.xxhash64("term"), F.lit(weights.files_per_bucket(rows, buckets)))
            rounds = min(buckets, max(1, -(-rows // weights.POSTINGS_PER_ROUND)))
            for i in range(rounds):
                laid = (
                    table.withColumn("_part", F.coalesce(hot_part, part) if name == "vectors" else part)
                    .select(*columns, "_part", weights.term_bucket(F.col("term"), buckets).alias("bucket"))
                    .filter(F.col("bucket") % rounds == i)
                    .repartition(max(buckets, -(-rows // per_file)) // rounds + 1, "bucket", "_part")
                )
                if name == "vectors":
                    # The blocks' weights lie beside the vectors: a table of their own would be moved twice more.
                    laid = search.block_weights(laid, ["bucket", "_part"], ["bucket", "term"])
                laid = laid.drop("_part").sortWithinPartitions("bucket", "term")
                laid.write.partitionBy("bucket").option("compression", "zstd").mode("append").parquet(f"{base}/{name}")
                if rounds > 1:
                    free_shuffles(self.spark)


def load_model(spark: SparkSession, path: str) -> SimilarityModel:
    """The last model that was saved to its end at ``path``; all its tables are of one save."""
    found = snapshots.current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no model at {path}")
    base = found["folders"][0]
    params = spark.read.parquet(f"{base}/params").first()
    vectors, blocks = spark.read.parquet(f"{base}/vectors"), None
    if "top" in vectors.columns:
        blocks = vectors.filter("top").select("term", "block", F.col("w").alias("most"), "bucket")
    elif "most" in vectors.columns:
        # As this one, models of earlier versions hold the weights themselves, or
        blocks = vectors.filter("most IS NOT NULL").select("term", "block", "most", "bucket")
    elif "has_blocks" in params and params["has_blocks"]:
        # a table of them.
        blocks = spark.read.parquet(f"{base}/blocks")
    return SimilarityModel(
        vocab=spark.read.parquet(f"{base}/vocab"),
        vectors=vectors.drop("top", "most"),
        labels=spark.read.parquet(f"{base}/labels"),
        mode=params["mode"],
        n_best=params["n_best"],
        label_names=tuple(params["label_names"]),
        stop_words=tuple(params["stop_words"]),
        lexicon=spark.read.parquet(f"{base}/lexicon") if params["has_lexicon"] else None,
        exceptions=spark.read.parquet(f"{base}/exceptions") if params["has_exceptions"] else None,
        buckets=params["buckets"],
        blocks=blocks,
    )


def check_keys(docs: DataFrame, id_col: str) -> None:
    """Raise unless every row has an id of its own: two texts of one id would be taken for one document."""
    seen = docs.agg(F.count("*").alias("rows"), F.count_distinct(id_col).alias("ids")).first()
    if seen["rows"] != seen["ids"]:
        raise ValueError(f"{id_col} must be unique and not null")


def fit(
    docs: DataFrame,
    corpus: str = "title_body",
    labels: Sequence[str] = ("url", "title"),
    id_col: str | None = None,
    mode: str = "default",
    n_best: int = 10,
    label_names: Sequence[str] = (),
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    lexicon: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> SimilarityModel:
    """Fit on a corpus column and its label columns.

    ``id_col`` names a unique integer id, which is checked; without one, rows are numbered and the numbering is written
    down. Raw counts and vocabulary are written to scratch tables: texts are analyzed once, and weighing joins tables of
    known size.
    """
    mode = tokens.check_mode(mode)
    if id_col is None:
        docs = materialize(docs.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
        id_col = "doc_id"
    else:
        check_keys(docs, id_col)
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(corpus).alias("text"))
    label_table = docs.select(F.col(id_col).alias("doc_id"), *labels)
    with passing(docs.sparkSession) as keep:
        found = None
        if mode != "none" and lexicon is None:
            # The texts are cut into tokens once, for the lexicon and for the counts.
            found = tokens.token_counts(frame, "text", tokens.TOKENIZERS[mode])
            lexicon = keep(materialize(tokens.lexicon_from(found), "lexicon"))
        elif lexicon is not None:
            lexicon = keep(materialize(lexicon.groupBy("token").agg(F.min("pos").alias("pos")), "lexicon"))
        counts = tokens.analyze(frame, mode=mode, lexicon=lexicon, stop_words=stop_words, exceptions=exceptions, counts=found)
        bags = keep(materialize(tokens.pack(counts), "bags"))
        counts = tokens.unpack(bags, "doc_id")
        vocab = keep(materialize(weights.idf(weights.doc_freq(counts), weights.corpus_size(frame)), "vocab"))
    return SimilarityModel(
        vocab=vocab,
        vectors=weights.weigh(counts, vocab),
        labels=label_table,
        mode=mode,
        n_best=n_best,
        label_names=tuple(label_names or labels),
        stop_words=tuple(stop_words),
        lexicon=lexicon,
        exceptions=exceptions,
        counts=counts,
        bags=bags,
    )
