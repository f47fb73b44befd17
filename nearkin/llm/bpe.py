"""Byte-level BPE encoding and decoding with the ranks of a public tokenizer.

A text is split by the tokenizer's pattern. Within a piece, bytes are mapped to Latin-1 characters; the trie of
an Aho-Corasick automaton gives the longest token at a place, and the encoder walks from left to right with the longest.
A token may follow another only if the merges keep the two apart. Where they don't, a shorter token is taken, which is settled
once per pair and remembered; where none is left the walk steps back. A place it left is never tried again
and tokens are of bounded length, so the work is linear in the piece.
The result is that of the merges in rank order.

Null texts are empty; empty texts have no ids. Ids that the ranks don't hold, as well as null ids, fail the job on decoding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nearkin.llm.words import held_by_worker, map_batches

# Remembered pieces of a worker in each of two generations, and pairs of neighbours; when full, pairs are built anew.
MAX_PIECES = 100_000
MAX_PAIRS = 300_000
# The rank file travels to every task.
MAX_RANK_BYTES = 64 * 1024 * 1024
# Texts whose characters are ASCII or these letters are split by a pattern that names them instead of classes.
EUROPEAN = "À-ÖØ-öø-ɏ"


def read_ranks(path: str) -> bytes:
    """A rank file as bytes; vocabularies are small, which is checked."""
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError("the rank file is too large to be sent to every task")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that splits a text at the matches of ``pattern``, in the syntax of the ``regex`` module."""
    full = regex.compile(pattern).findall
    names = {r"\p{L}": f"A-Za-z{EUROPEAN}", r"\p{N}": "0-9", r"\s": r"\t-\r "}

    def named(text: str, form: str) -> str:
        for name, chars in names.items():
            text = text.replace(name, form.format(chars))
        return text

    plain = named(re.sub(r"\[[^\]]*\]", lambda m: named(m[0], "{}"), pattern), "[{}]").replace(r"\S", r"[^\t-\r ]")
    if re.search(r"\\[pPwWdDbB]", plain):
        return full
    fast, other = re.compile(plain).findall, re.compile(f"[^\x00-\x7f{EUROPEAN}]").search
    return lambda text: full(text) if other(text) else fast(text)


def merge(ranks: dict[bytes, int], piece: bytes, parts: int = 1) -> list[int]:
    """The merges as they are defined, until ``parts`` are left: lowest rank first, the leftmost of equals."""
    kept = [piece[i : i + 1] for i in range(len(piece))]
    while len(kept) > parts:
        joined = [ranks.get(a + b, len(ranks)) for a, b in pairwise(kept)]
        best = min(joined)
        if best == len(ranks):
            break
        i = joined.index(best)
        kept[i : i + 2] = [kept[i] + kept[i + 1]]
    return [ranks[part] for part in kept]


class Pairs:
    """Whether the merges leave two neighbouring tokens as they are, by their ranks.

    The merges that made the two are undone, the latest first. Whenever the ends that then touch merge, and
    rank before the merges that took them away, the merges would have joined them.
    """

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens
        self.parts: dict[int, tuple[int, int]] = {}

    def last_merge(self, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one."""
        if rank not in self.parts:
            token = self.tokens[rank]
            left, right = merge(self.ranks, token, parts=2)
            self.parts[rank] = (left, right)
        return self.parts[rank]

    def settle(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        ends, starts = tokens[left], tokens[right]
        left_gone = right_gone = float("inf")
        while True:
            joined = ranks.get(ends + starts)
            # Of equal ranks the leftmost merge comes first.
            if joined is not None and joined < left_gone and joined <= right_gone:
                return False
            if len(ends) > 1 and (left > right or len(starts) == 1):
                left_gone, left = left, self.last_merge(left)[1]
                ends = tokens[left]
            elif len(starts) > 1:
                right_gone, right = right, self.last_merge(right)[0]
                starts = tokens[right]
            else:
                return True


class Fitting(dict):
    """After one token, the longest that may follow among a token and its shorter ones, by rank; None where there is none.

    Each is settled once. Without a token before, every one may follow.
    """

    def __init__(self, encoder: Encoder, left: int | None):
        super().__init__({None: None})
        self.encoder, self.left = encoder, left

    def __missing__(self, rank: int) -> int | None:
        encoder, fit = self.encoder, rank
        while fit is not None and self.left is not None and not encoder.pairs.settle(self.left, fit):
            fit = encoder.shorter[fit]
        if encoder.n_fitting >= MAX_PAIRS:
            encoder.fitting.clear()
            encoder.n_fitting = 0
        self[rank] = fit
        encoder.n_fitting += 1
        return fit


class Encoder(dict):
    """Ids of pieces by the text of the piece; a missing one is encoded and kept.

    When full, what was kept becomes the older generation, from which pieces come back when they are met again.
    """

    def __init__(self, data: bytes):
        self.older: dict[str, tuple[int, ...]] = {}
        self.ranks = ranks = parse_ranks(data)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.pairs = Pairs(ranks, self.tokens)
        # What may follow each token, by its rank, and the number of entries in all.
        self.fitting: dict[int | None, Fitting] = {}
        self.n_fitting = 0
        self.trie = ahocorasick.Automaton()
        # The longest token at the start of each string that begins a token; of a token, the next shorter one.
        self.best: dict[str, int] = {}
        self.shorter: dict[int, int | None] = {}
        for token in sorted(ranks):
            chars, rank = token.decode("latin-1"), ranks[token]
            self.trie.add_word(chars, rank)
            longest = None
            for size in range(1, len(chars)):
                longest = self.best.setdefault(chars[:size], longest)
            self.shorter[rank], self.best[chars] = longest, rank
        self.trie.make_automaton()
        self.longest = max(map(len, ranks))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self.encode(piece.encode())
        self[piece] = ids
        return ids

    def after(self, left: int | None) -> Fitting:
        if left not in self.fitting:
            self.fitting[left] = Fitting(self, left)
        return self.fitting[left]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        reach, best, longest, after = self.trie.longest_prefix, self.best, self.longest, self.after
        shorter, sizes, known = self.shorter, self.sizes, self.fitting.get
        chars, end = piece.decode("latin-1"), len(piece)
        out: list[int] = []
        left_places: set[int] = set()
        at, fits = 0, after(None)
        while at < end:
            here = chars[at : at + longest]
            rank = fits[best.get(here[: reach(here)])]
            while rank is None or at + sizes[rank] in left_places:
                if rank is not None:
                    rank = fits[shorter[rank]]
                elif not out:
                    raise ValueError("the ranks don't hold every byte")
                else:
                    # No token fits here, so the one before is a shorter one.
                    left_places.add(at)
                    gone = out.pop()
                    at -= sizes[gone]
                    fits = after(out[-1] if out else None)
                    rank = fits[shorter[gone]]
            out.append(rank)
            at += sizes[rank]
            fits = known(rank) or after(rank)
        return tuple(out)


def encode(df: DataFrame, data: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by ``ids array<int>``; other columns stay, but for one that is named ``ids``.

    ``data`` is a rank file's content.
    """
    df = df.drop(ids) if ids != text else df
    shared = df.sparkSession.sparkContext.broadcast(data)
    key = (hashlib.sha256(data).hexdigest(), pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, split = held_by_worker("bpe", key, lambda: (Encoder(shared.value), splitter(pattern)))
        flat, ends = array("i"), array("i", [0])
        for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
            if value:
                flat.extend(chain.from_iterable(map(encoder.__getitem__, split(value))))
            ends.append(len(flat))
        column = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32)))
        return _replaced(batch, text, ids, column)

    return map_batches(df, run, _schema(df, text, f"`{ids}` array<int>"))


def decode(df: DataFrame, data: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Replace the column ``ids`` by the bytes they stand for, ``text binary``; other columns stay, but for one that is named so."""
    df = df.drop(text) if ids != text else df
    shared = df.sparkSession.sparkContext.broadcast(data)
    key = hashlib.sha256(data).hexdigest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = held_by_worker("bpe tokens", key, lambda: token_array(shared.value))
        return _replaced(batch, ids, text, joined(batch.column(batch.schema.get_field_index(ids)), tokens))

    return map_batches(df, run, _schema(df, ids, f"`{text}` binary"))


def token_array(data: bytes) -> pa.LargeBinaryArray:
    """The tokens by rank; null where there is none."""
    tokens = {rank: token for token, rank in parse_ranks(data).items()}
    return pa.array(map(tokens.get, range(max(tokens) + 1)), pa.large_binary())


def joined(ids: pa.ListArray, tokens: pa.LargeBinaryArray) -> pa.BinaryArray:
    """The bytes that each list of ids stands for; tokens taken in a row lie in memory as the texts do."""
    found = tokens.take(ids.flatten())
    if found.null_count:
        raise ValueError("there are ids that the ranks don't hold")
    counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    _, offsets, data = found.buffers()
    places = np.frombuffer(offsets, np.int64)[ends] if len(found) else np.zeros(len(ends), np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(places), data]).cast(pa.binary())


def _schema(df: DataFrame, gone: str, new: str) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != gone]
    return ", ".join([*kept, new])


def _replaced(batch: pa.RecordBatch, gone: str, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != gone]
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*columns, column], names=[*names, name])
