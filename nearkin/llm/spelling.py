"""Group spelling variants: words of a corpus that are one edit apart, and the frequent form each belongs to.

Words are counted per batch within the tasks and added up by word, so a frequent word costs little. Each letter is
hashed to one of a few symbols. For every word all spellings one edit away from its reduced form (and that form
itself) are generated as 64-bit keys and joined to the keys of the vocabulary's reduced words. One edit of a word is
at most one edit of its reduced form, so nothing is lost; the edit distance of the words themselves decides. Where
more than ``CROWD`` words share a reduced form, they meet only where they also agree in the whole word or one with a
letter left out, as any two near words do.

A word's form is its most frequent near word (the smallest of equals) if that is at least ``times`` as frequent, and its
root is where forms lead to. Frequencies grow along forms, so they end; they are followed by doubling.

Null and empty texts have no words, null ids count as empty. Repeated rows count again.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
SYMBOLS = 8
MIN_CHARS = 6
MIN_COUNT = 5
TIMES = 5
CROWD = 1000
# Counts that a task holds before it passes them on, and keys that it makes at a time.
HELD_WORDS = 200_000
HELD_KEYS = 1 << 20
# A reduced word is the polynomial of its symbols (from 1) in this base modulo 2**64; the base is odd and has an inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(df: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, typos: int = 0) -> DataFrame:
    """``(word, n)``: how often each run of letters of at least ``min_chars`` stands in the texts, A-Z in lower case.

    ``typos`` leaves a letter out of each run of a document whose CRC-32 of ``id:run`` it divides, the same one
    wherever the run stands in the document; 0 leaves all as they are.
    """
    # A maximal run matches as a whole; shorter ones can't.
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0).cast(pa.string()), batch.column(1)):
                found = Counter(runs(value.as_py() or ""))
                if typos:
                    start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for word, n in found.items():
                    word = word.translate(_LOWER) if not word.islower() else word
                    if typos and (h := zlib.crc32(word.encode(), start)) % typos == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_chars:
                            continue
                    counts[word] += n
                if len(counts) > HELD_WORDS:
                    yield sent()
        if counts:
            yield sent()

    rows = df.select(F.col(id_col).cast("string"), F.col(text))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str]) -> np.ndarray:
    """The code points, and one, of words of one length; a row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return codes.astype(np.uint64).reshape(len(words), -1) + np.uint64(1)


def _symbols(words: list[str], symbols: int) -> np.ndarray:
    """The symbols, from 1, of words of one length; a row per word."""
    codes = _codes(words)
    return ((codes * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(symbols) >> np.uint64(32)) + np.uint64(1)


def _sums(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and the polynomial of every beginning of the rows."""
    powers = np.multiply.accumulate(np.full(marks.shape[1] + 1, BASE, np.uint64)) * np.uint64(INVERSE)
    sums = np.zeros((marks.shape[0], marks.shape[1] + 1), np.uint64)
    np.cumsum(marks * powers[:-1], axis=1, out=sums[:, 1:])
    return powers, sums


def reduced_keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The key of the reduced form of words of one length."""
    return _sums(_symbols(words, symbols))[1][:, -1]


def neighbour_keys(words: list[str], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words of one length, the number of the word and the key of each reduced word at most one edit from its own, in blocks.

    Within a block each key stands once per word.
    """
    marks = _symbols(words, symbols)
    powers, sums = _sums(marks)
    whole, length = sums[:, -1:], marks.shape[1]
    base, inverse = np.uint64(BASE), np.uint64(INVERSE)
    any_mark = np.arange(1, symbols + 1, dtype=np.uint64)
    step = max(1, HELD_KEYS // (len(words) * (2 * symbols + 1)))
    for i in range(0, length + 1, step):
        at, into = np.arange(i, min(i + step, length)), np.arange(i, min(i + step, length + 1))
        before = sums[:, into]
        inserted = (before + (whole - before) * base)[:, :, None] + any_mark * powers[into][:, None]
        replaced = whole[:, :, None] + (any_mark - marks[:, at][:, :, None]) * powers[at][:, None]
        deleted = sums[:, at] + (whole - sums[:, at + 1]) * inverse
        keys = np.concatenate([whole, deleted, replaced.reshape(len(words), -1), inserted.reshape(len(words), -1)], 1)
        keys.sort(axis=1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        yield np.nonzero(fresh)[0], keys[fresh]


def _by_length(words: list[str], each: int) -> Iterator[np.ndarray]:
    """Places of words of one length, in parts of which each word may make ``each`` keys a letter."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        size = max(1, HELD_KEYS // (each * max(int(length), 1)))
        yield from (at[i : i + size] for i in range(0, len(at), size))


def _reduced(vocab: DataFrame, symbols: int) -> DataFrame:
    """``vocab(word, n)`` with the key of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in _by_length(words, 1):
                keys = reduced_keys([words[i] for i in at], symbols)
                yield batch.take(pa.array(at)).append_column("key", pa.array(keys.view(np.int64)))

    return vocab.mapInArrow(run, "word string, n long, key long")


def _neighbourhoods(reduced: DataFrame, symbols: int) -> DataFrame:
    """``(own, key)``: for each ``(key, word)`` of a reduced word, its key and those of all reduced words one edit away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in _by_length(words, 2 * symbols + 1):
                for row, keys in neighbour_keys([words[i] for i in at], symbols):
                    yield pa.RecordBatch.from_arrays([pa.array(own[at][row]), pa.array(keys.view(np.int64))], names=["own", "key"])

    return reduced.select("key", "word").mapInArrow(run, "own long, key long")


def _left_out(keyed: DataFrame) -> DataFrame:
    """``(word, n, key, variant)``: keys of the word itself and of the words with one of its letters left out, unreduced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for at in _by_length(words, 1):
                sums = _sums(_codes([words[i] for i in at]))[1]
                keys = np.concatenate([sums[:, -1:], sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * np.uint64(INVERSE)], 1)
                keys.sort(axis=1)
                fresh = np.concatenate([np.ones((len(at), 1), bool), keys[:, 1:] != keys[:, :-1]], 1)
                # The word itself goes along; long ones in few rows at a time.
                rows, keys = np.nonzero(fresh)[0], keys[fresh]
                step = max(1, HELD_KEYS // sums.shape[1])
                for i in range(0, len(rows), step):
                    part = batch.take(pa.array(at[rows[i : i + step]]))
                    yield part.append_column("variant", pa.array(keys[i : i + step].view(np.int64)))

    return keyed.mapInArrow(run, "word string, n long, key long, variant long")


def near_words(vocab: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """``(word, near, near_n)`` for all words of ``vocab(word, n)`` and each word exactly one edit away, in both directions."""
    keyed = materialize(_reduced(vocab, symbols), "keyed")
    reduced = materialize(keyed.groupBy("key").agg(F.min("word").alias("word"), F.count("*").alias("words")), "reduced")
    sizes = reduced.select("key", "words")
    links = _neighbourhoods(reduced, symbols).join(sizes, "key")
    links = links.join(sizes.select(F.col("key").alias("own"), F.col("words").alias("own_words")), "own")
    links = materialize(links.select("own", "key", (F.greatest("words", "own_words") > crowd).alias("crowded")), "links")
    mine = keyed.select(F.col("key").alias("own"), "word")
    other = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = links.filter("NOT crowded").join(mine, "own").join(other, "key").select("word", "near", "near_n")
    crowded = links.filter("crowded").select("own", "key")
    told = materialize(_left_out(keyed.join(crowded.select(F.col("own").alias("key")).distinct(), "key", "left_semi").select("word", "n", "key")), "variants")
    mine = crowded.join(told.select(F.col("key").alias("own"), "word", "variant"), "own")
    other = told.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"), "variant")
    more = mine.join(other, ["key", "variant"]).select("word", "near", "near_n")
    one_apart = (F.abs(F.char_length("word") - F.char_length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return pairs.filter(one_apart).unionByName(more.filter(one_apart).distinct())


def forms(vocab: DataFrame, near: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, n, n_near, form_n)`` for all words of ``vocab(word, n)``."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("best"), (-F.col("best.col1")).alias("best_n"))
    fits = F.col("best_n") >= times * F.col("n")
    return vocab.join(best, "word", "left").select(
        "word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(fits, F.col("best_n")).alias("form_n"),
    )


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)`` for ``links(word, form)`` without cycles: the last word that forms lead to. Each round doubles the way."""
    hops = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = materialize(
            hops.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots",
        )
        if hops.filter("moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def variants(counts: DataFrame, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for the words of ``counts(word, n)`` that are frequent enough."""
    vocab = materialize(counts.filter(F.col("n") >= min_count), "vocab")
    told = materialize(forms(vocab, near_words(vocab), times), "forms")
    ends = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
