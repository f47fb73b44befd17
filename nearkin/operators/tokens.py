"""Analyzers: texts to ``(id, term, tf)`` rows.

Three modes: ``none`` takes word tokens as they are, ``default`` lemmatizes every
token as a noun, ``custom`` keeps nouns and verbs and lemmatizes them by part of speech. Lemma and part of
speech are looked up in a lexicon table by join, once per distinct token.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions import text as T
from nearkin.functions.wordlists import ENGLISH_STOP_WORDS, LEMMA_RULES, POS_ENDINGS
from nearkin.operators.features import kth_smallest
from nearkin.session import materialize

Tokenizer = Callable[[Column], Column]
TOKENIZERS = {"none": T.tokens_word, "default": T.tokens_punct, "custom": T.tokens_alpha}
MIN_TERM = 3
# Bytes of text whose tokens a task counts. Left to the size of the compressed exchange, a task would take several times as much.
TEXT_BYTES_PER_TASK = 16 * 1024 * 1024
# A table of terms is broadcast up to so many rows.
VOCAB_ROWS = 262_144


def term_bucket(term: Column, buckets: int) -> Column:
    """The folder a term is stored in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def check_mode(mode: str) -> str:
    mode = mode.lower()
    if mode not in TOKENIZERS:
        raise ValueError("mode must be default, custom or none")
    return mode


def token_rows(docs: DataFrame, text: str, tokenizer: Tokenizer, id_col: str = "doc_id", small: bool = False) -> DataFrame:
    """``(id, token)``, one row per occurrence, partitioned by id.

    The exchange of the raw texts is the only one they go through: counts, document frequencies and norms all
    start from it, and Spark reuses it within a plan. Its partitions follow from the bytes of the texts, which are summed up
    where they lie, so a task's memory doesn't grow with the corpus; texts that are ``small`` aren't measured.
    """
    frame = docs.select(id_col, text)
    parts = 1 if small else text_parts(frame, text)
    frame = frame.repartition(parts, id_col) if parts > 1 else frame.repartition(id_col)
    return frame.select(id_col, F.explode(tokenizer(F.col(text))).alias("token"))


def text_parts(docs: DataFrame, text: str) -> int:
    """Partitions for texts of this size: 1 where one task does, else one per core at least."""
    if docs.isStreaming:
        return 1
    parts = -(-(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // TEXT_BYTES_PER_TASK)
    return max(parts, docs.sparkSession.sparkContext.defaultParallelism) if parts > 1 else 1


def guess_pos(token: Column) -> Column:
    """Part of speech from the ending of a word; nouns unless an ending says otherwise."""
    guess = F.lit("N")
    for pos, endings in reversed(POS_ENDINGS):
        hit = F.lit(False)
        for ending in endings:
            hit = hit | token.endswith(ending)
        guess = F.when(hit, pos).otherwise(guess)
    return guess


def lexicon_from(tokens: DataFrame) -> DataFrame:
    """``(token, pos)`` from the distinct tokens of a corpus, for use where no lexicon is at hand."""
    return tokens.select("token").distinct().withColumn("pos", guess_pos(F.col("token")))


def with_pos(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add ``pos`` from the lexicon; unknown words count as nouns.

    A lexicon may list a word once only.
    """
    known = lexicon.select("token", F.col("pos").alias("known_pos"))
    return words.join(known, "token", "left").select(
        *words.columns, F.coalesce("known_pos", F.lit("N")).alias("pos")
    )


def pos_filter(words: DataFrame, lexicon: DataFrame, keep: Sequence[str] = ("N", "V")) -> DataFrame:
    """Rows whose token is tagged with one of the initials in ``keep``."""
    return with_pos(words, lexicon).filter(F.substring("pos", 1, 1).isin(list(keep)))


def _bases(token: Column, pos: str) -> Column:
    """Every base form the suffix rules allow; the lexicon decides which exist."""
    forms = [
        F.when(
            token.endswith(suffix) & (F.length(token) > len(suffix)),
            F.concat(token.substr(F.lit(1), F.length(token) - len(suffix)), F.lit(base)),
        )
        for suffix, base in LEMMA_RULES[pos]
    ]
    return F.array_compact(F.array(*forms))


def narrow_lexicon(lexicon: DataFrame, words: DataFrame, buckets: int | None = None) -> DataFrame:
    """The rows of a lexicon that few ``words`` can need: theirs and those of their base forms, as a small written table.

    The words are broadcast and the lexicon is read once, where it lies; one stored in ``buckets`` folders only in theirs.
    """
    token = F.col("token")
    forms = F.array_union(F.array(token), F.array_union(_bases(token, "N"), _bases(token, "V")))
    needed, on = words.select(F.explode(forms).alias("token")).distinct(), ["token"]
    if buckets:
        needed, on = needed.withColumn("bucket", term_bucket(token, buckets)), ["bucket", "token"]
    return materialize(lexicon.join(F.broadcast(needed), on, "left_semi").select("token", "pos"), "lexicon")


def lemma_map(
    words: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None
) -> DataFrame:
    """``(token, pos, lemma)`` for distinct ``(token, pos)`` rows with pos N or V.

    The lemma is the shortest form found in the lexicon among the token and its bases; the token itself when
    there is none. ``exceptions(token, pos, lemma)`` holds irregular forms and wins.
    """
    known = lexicon.select(F.col("token").alias("form")).distinct()
    initial = F.substring("pos", 1, 1)
    bases = F.when(initial == "V", _bases(F.col("token"), "V")).otherwise(_bases(F.col("token"), "N"))
    forms = words.select(
        "token", "pos", F.explode(F.array_union(F.array("token"), bases)).alias("form")
    )
    found = (
        forms.join(known, "form", "left_semi")
        .groupBy("token", "pos")
        .agg(F.min(F.struct(F.length("form").alias("n"), "form"))["form"].alias("base"))
    )
    lemmas = words.join(found, ["token", "pos"], "left")
    lemma = F.coalesce("base", "token")
    if exceptions is not None:
        irregular = exceptions.select("token", "pos", F.col("lemma").alias("irregular"))
        lemmas = lemmas.join(irregular, ["token", "pos"], "left")
        lemma = F.coalesce("irregular", "base", "token")
    return lemmas.select("token", "pos", lemma.alias("lemma"))


def term_map(
    words: DataFrame,
    mode: str,
    lexicon: DataFrame,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """``(token, term)`` for the distinct tokens that survive an analyzer with lemmas.

    Part of speech, lemma, minimum length and stop words (matched against lemmas) all depend on the token
    alone, so they are settled once per distinct token instead of once per occurrence.
    """
    distinct = words.select("token").distinct()
    if check_mode(mode) == "custom":
        tagged = pos_filter(distinct, lexicon)
    else:
        tagged = distinct.withColumn("pos", F.lit("N"))
    return (
        lemma_map(tagged, lexicon, exceptions)
        .filter((F.length("lemma") >= MIN_TERM) & ~F.col("lemma").isin(list(stop_words)))
        .select("token", F.col("lemma").alias("term"))
    )


def token_counts(docs: DataFrame, text: str, tokenizer: Tokenizer, id_col: str = "doc_id", small: bool = False) -> DataFrame:
    """``(id, token, n)``, written: the occurrences of each token of a text."""
    rows = token_rows(docs, text, tokenizer, id_col, small)
    return materialize(rows.groupBy(id_col, "token").agg(F.count("*").alias("n")), "tokens")


def common_terms(terms: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A table of terms with their ``df`` in two: the most frequent ones, few enough to be broadcast, and the others, if any."""
    beyond = terms.count() - VOCAB_ROWS
    if beyond <= 0:
        return terms, None
    least = kth_smallest(terms, "df", beyond)
    return terms.filter(F.col("df") > least), terms.filter(F.col("df") <= least)


def join_terms(rows: DataFrame, terms: DataFrame, on: str) -> DataFrame:
    """``rows`` joined to a written table of terms, which holds all of theirs with their ``df``.

    The most frequent terms, which most rows hold, are broadcast; only the rows of the others are moved.
    """
    common, rest = common_terms(terms)
    known = rows.join(F.broadcast(common), on)
    if rest is None:
        return known
    others = rows.join(F.broadcast(common.select(on)), on, "left_anti").join(rest, on)
    return known.unionByName(others)


def pack(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, terms, tfs)``: counts ``(id, term, tf)`` as one row a text."""
    bags = counts.groupBy(id_col).agg(F.collect_list(F.struct("term", "tf")).alias("bag"))
    return bags.select(id_col, F.col("bag.term").alias("terms"), F.col("bag.tf").alias("tfs"))


def unpack(bags: DataFrame, *columns: str) -> DataFrame:
    """``(columns…, term, tf)``: a row for each term of ``(columns…, terms, tfs)``."""
    rows = bags.select(*columns, F.inline(F.arrays_zip("terms", "tfs")))
    return rows.withColumnsRenamed({"terms": "term", "tfs": "tf"})


def analyze(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    mode: str = "none",
    lexicon: DataFrame | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    exceptions: DataFrame | None = None,
    tokenizer: Tokenizer | None = None,
    small: bool = False,
    buckets: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Raw term counts ``(id, term, tf)`` of each text.

    Modes with lemmas use ``lexicon(token, pos)``; without one it is drawn from ``docs`` itself. They write token
    counts and the term of each token to scratch tables, unless ``small`` says the texts passed ``is_small``: the
    counts are read more than once, and a join of two tables lets Spark split a token most texts contain. Of small texts
    only the counts are written, and the lexicon, stored in ``buckets`` folders or not, is narrowed to their words first.
    ``tokenizer``, a function from a string column to an array column, replaces the mode's own. Modes with lemmas don't
    read the texts if their ``token_counts``, a table, are given as ``counts``.
    """
    mode = check_mode(mode)
    if mode == "none":
        rows = token_rows(docs, text, tokenizer or TOKENIZERS[mode], id_col, small)
        kept = rows.withColumnRenamed("token", "term").filter(~F.col("term").isin(list(stop_words)))
        return kept.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    if counts is None:
        counts = token_counts(docs, text, tokenizer or TOKENIZERS[mode], id_col, small)
    if lexicon is None:
        lexicon = lexicon_from(counts)
    elif small:
        lexicon = narrow_lexicon(lexicon, counts, buckets)
    if small:
        mapping = term_map(counts, mode, lexicon, stop_words, exceptions)
        return counts.join(mapping, "token").groupBy(id_col, "term").agg(F.sum("n").alias("tf"))
    words = materialize(counts.groupBy("token").agg(F.count("*").alias("df")), "words")
    mapping = words.join(term_map(words, mode, lexicon, stop_words, exceptions), "token", "left")
    mapping = materialize(mapping.select("token", "df", "term"), "terms")
    # Tokens that are left out have no term. All terms of a text are brought together, so that its vector needs no further exchange.
    found = join_terms(counts, mapping, "token").filter(F.col("term").isNotNull())
    return found.select(id_col, "term", "n").repartition(id_col).groupBy(id_col, "term").agg(F.sum("n").alias("tf"))
