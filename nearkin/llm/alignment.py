"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a sentencepiece model (B).

Both tokenizers say where their tokens stand: A in characters, B in spans of its proto (the installed release names the
immutable proto just ``proto``). These are coarse cuts. Where a character of several bytes is shared by tokens, or where
B falls back to bytes, the spans of neighbours touch or are empty; there the bytes that the tokens stand for move the cut
to its place within the character. Byte offsets at which a token of A and one of B both end cut the two sequences into
groups, the smallest parts that hold the same bytes in both.

A text is encoded with a space before it, which B adds by itself; strings of special tokens are plain text. Null and
empty texts have no tokens, nor have texts whose tokens don't spell them (white space or signs that B writes in another way).
Repeated rows are rows of their own; an id pair counts once in each row that holds it.

Between two words a single space always starts a token in both, so a text falls into chunks, each aligned by itself and
remembered by the worker. Where a vocabulary holds tokens that run on over a space, texts are aligned whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearkin.llm.words import held_by_worker, map_batches
from nearkin.session import materialize

# A link is one number: A's id above, B's id in the low bits.
B_BITS = 32
# Chunks part at a space with such signs on both sides; neither tokenizer joins over it.
APART = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")
SIGNS = frozenset(map(chr, [*range(ord("!"), ord("~") + 1), *range(ord("À"), ord("ɏ") + 1)]))
# Remembered chunks of a worker in each of two generations, and the longest that is.
MAX_CHUNKS = 400_000
MAX_CHUNK_CHARS = 64
# Both files travel to every task.
MAX_FILE_BYTES = 64 * 1024 * 1024
# Links that stand in most rows are looked up in each task, up to so many; the others are joined.
COMMON_LINKS = 1_000_000
# Groups with more pairs than this are counted by distinct ids.
LARGE_GROUP = 65_536
ROWS = 64


def read_file(path: str) -> bytes:
    """A tokenizer's file as bytes, which are sent to every task; its size is checked."""
    with open(path, "rb") as file:
        data = file.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError("the tokenizer's file is too large to be sent to every task")
    return data


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_tokens(vocab: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; entries with other characters stand for their own text."""
    to_byte = byte_chars()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        known = all(c in to_byte for c in token)
        out[i] = bytes(to_byte[c] for c in token) if known else token.encode()
    return out


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, a byte piece its byte."""
    return [
        bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        for i, piece in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
    ]


class Vocabulary:
    """Bytes of the tokens of one vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.tokens = pa.array(tokens, pa.large_binary())

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these tokens in a row."""
        return np.frombuffer(self.tokens.take(pa.array(ids)).buffers()[2] or b"", np.uint8)[: int(self.lengths[ids].sum())]


def segments(stops: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of the values before each stop since the last one."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return np.diff(sums[stops], prepend=0)


def places(ids: np.ndarray, stops: np.ndarray, lengths: np.ndarray, starts: np.ndarray, coarse: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Where each token ends, from the start of the text with number 0.

    ``coarse`` spans hold where they are as long as the token's bytes and join on to what stands before; elsewhere tokens
    share a character or are bytes of one, and their own lengths give the place. ``base`` is the start of each text.
    """
    size = lengths[ids]
    of = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
    coarse, starts = coarse + base[of], starts + base[of]
    before = np.concatenate([[0], np.cumsum(size)])
    own = before[1:] - before[np.concatenate([[0], stops[:-1]])][of] + base[of]
    return np.where((coarse - starts == size) & (coarse == own), coarse, own)


@dataclass
class Aligned:
    """Ids of both tokenizers over some texts in a row, and where they end; ``cuts`` is where both end.

    The stops say after which token, cut and byte each text ends.
    """

    a: np.ndarray
    a_ends: np.ndarray
    a_stops: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray
    b_stops: np.ndarray
    cuts: np.ndarray
    stops: np.ndarray

    def __post_init__(self):
        # After which tokens each group ends, its number of tokens, and the group of each token.
        self.a_last = np.searchsorted(self.a_ends, self.cuts, "right")
        self.b_last = np.searchsorted(self.b_ends, self.cuts, "right")
        self.a_count, self.b_count = np.diff(self.a_last, prepend=0), np.diff(self.b_last, prepend=0)
        n = np.arange(len(self.cuts))
        self.a_group, self.b_group = np.repeat(n, self.a_count), np.repeat(n, self.b_count)
        # Groups before the end of each text.
        self.groups = np.searchsorted(self.cuts, self.stops, "right")

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of ids that share a group, how often each does, and how many each text has; sorted within a text."""
        pairs = self.a_count * self.b_count
        text = np.repeat(np.arange(len(self.groups)), np.diff(self.groups, prepend=0))
        high, low = self.a.astype(np.int64) << B_BITS, self.b.astype(np.int64)
        partners = np.where((pairs <= LARGE_GROUP)[self.a_group], self.b_count[self.a_group], 0)
        first = np.cumsum(partners) - partners
        at = np.arange(int(partners.sum())) + np.repeat((self.b_last - self.b_count)[self.a_group] - first, partners)
        parts = [(np.repeat(text[self.a_group], partners), np.repeat(high, partners) | low[at], np.ones(len(at), np.int64))]
        for g in np.flatnonzero(pairs > LARGE_GROUP):
            one, n_one = np.unique(high[self.a_last[g] - self.a_count[g] : self.a_last[g]], return_counts=True)
            two, n_two = np.unique(low[self.b_last[g] - self.b_count[g] : self.b_last[g]], return_counts=True)
            codes = (one[:, None] | two[None, :]).ravel()
            parts.append((np.full(len(codes), text[g]), codes, (n_one[:, None] * n_two[None, :]).ravel()))
        texts, codes, times = map(np.concatenate, zip(*parts))
        order = np.lexsort((codes, texts))
        texts, codes, times = texts[order], codes[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (texts[1:] != texts[:-1]) | (codes[1:] != codes[:-1])])[: len(codes)])
        times = np.add.reduceat(times, first) if len(first) else times
        return codes[first], times, np.bincount(texts[first], minlength=len(self.groups))


class Aligner:
    """Both tokenizers, from the contents of their files, and the chunks that were aligned so far."""

    def __init__(self, a_json: bytes, b_model: bytes):
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        says = json.loads(a_json)
        entries = says["model"]["vocab"] | {t["content"]: t["id"] for t in says.get("added_tokens") or ()}
        self.a_vocab, self.b_vocab = Vocabulary(byte_level_tokens(entries)), Vocabulary(piece_tokens(self.b))
        split = says.get("pre_tokenizer") or {}
        by_space = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        runs_on = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.apart = APART.split if by_space and not says.get("normalizer") and not runs_on else lambda text: [text]
        # An id and the sign after it: within a side, or at the end of A's and of B's.
        signs = [f"{i}{sign}".encode() for vocab, pair in ((self.a_vocab, ",|"), (self.b_vocab, ",;")) for i in range(len(vocab.lengths)) for sign in pair]
        self.signs = Vocabulary(signs)
        self.chunks: dict[str, tuple | bool] = {}
        self.older: dict[str, tuple | bool] = {}

    def align(self, texts: Sequence[str]) -> tuple[Aligned, np.ndarray]:
        """The alignment of texts that are not empty, and which of them have tokens; the others have none in it."""
        spaced = [" " + text for text in texts]
        coded = [text.encode() for text in spaced]
        found = self.a.encode_batch(spaced, add_special_tokens=False)
        mapped = self.b.encode(list(texts), return_type="offset_mapping", num_threads=1)
        sizes = np.array([len(c) for c in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        base = np.cumsum(sizes) - sizes
        # The byte at which each character starts; characters are counted over all texts.
        chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        char_base = np.cumsum([len(t) for t in spaced]) - [len(t) for t in spaced]

        a = np.fromiter(chain.from_iterable(f.ids for f in found), np.int64)
        a_stops = np.cumsum([len(f) for f in found])
        of = np.repeat(np.arange(len(texts)), np.diff(a_stops, prepend=0))
        span = np.fromiter(chain.from_iterable(chain.from_iterable(f.offsets for f in found)), np.int64).reshape(-1, 2)
        span = chars[span + char_base[of][:, None]] - base[of][:, None]
        a_ends = places(a, a_stops, self.a_vocab.lengths, span[:, 0], span[:, 1], base)

        b = np.fromiter(chain.from_iterable(m["ids"] for m in mapped), np.int64)
        b_stops = np.cumsum([len(m["ids"]) for m in mapped])
        of = np.repeat(np.arange(len(texts)), np.diff(b_stops, prepend=0))
        span = np.fromiter(chain.from_iterable(chain.from_iterable(m["offsets"] for m in mapped)), np.int64).reshape(-1, 2)
        # B's spans lie in the text without the space before it, which its first token holds.
        first = np.zeros(len(b), np.int64)
        first[np.concatenate([[0], b_stops[:-1]])[np.diff(b_stops, prepend=0) > 0]] = 1
        span = span + np.stack([1 - first, np.ones_like(first)], 1)
        span = chars[np.minimum(span + char_base[of][:, None], len(chars) - 1)] - base[of][:, None]
        b_ends = places(b, b_stops, self.b_vocab.lengths, span[:, 0], span[:, 1], base)

        good = self._spelled(self.a_vocab, a, a_stops, data, sizes) & self._spelled(self.b_vocab, b, b_stops, data, sizes)
        if not good.all():
            a_good, b_good = (np.repeat(good, np.diff(stops, prepend=0)) for stops in (a_stops, b_stops))
            a, a_ends, b, b_ends = a[a_good], a_ends[a_good], b[b_good], b_ends[b_good]
            a_stops, b_stops = (np.cumsum(np.where(good, np.diff(stops, prepend=0), 0)) for stops in (a_stops, b_stops))
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        return Aligned(a, a_ends, a_stops, b, b_ends, b_stops, cuts, base + sizes), good

    @staticmethod
    def _spelled(vocab: Vocabulary, ids: np.ndarray, stops: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts the tokens spell byte by byte."""
        lengths = segments(stops, vocab.lengths[ids])
        good = lengths == sizes
        own = vocab.spelled(ids[np.repeat(good, np.diff(stops, prepend=0))])
        wanted = data if good.all() else data[np.repeat(good, sizes)]
        if not np.array_equal(own, wanted):
            ends = np.cumsum(sizes[good])
            good[np.flatnonzero(good)[segments(ends, own != wanted) > 0]] = False
        return good

    def written(self, found: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` with decimal ids for each text."""
        order = np.empty(len(found.a) + len(found.b), np.int64)
        last = np.zeros(len(order), bool)
        a_place = np.arange(len(found.a)) + (found.b_last - found.b_count)[found.a_group]
        b_place = np.arange(len(found.b)) + found.a_last[found.b_group]
        last[a_place[found.a_last - 1]] = last[b_place[found.b_last - 1]] = True
        order[a_place], order[b_place] = 2 * found.a, 2 * (len(self.a_vocab.lengths) + found.b)
        order += last
        out = self.signs.spelled(order).tobytes()
        stops = np.concatenate([[0], np.cumsum(self.signs.lengths[order])])[found.a_stops + found.b_stops]
        stops = stops.tolist()
        return [out[i : max(i, j - 1)] for i, j in zip([0, *stops[:-1]], stops)]

    def align_chunks(self, chunks: Sequence[str]) -> tuple[Aligned, np.ndarray]:
        """``align`` for chunks that may stand next to each other: as one text, whose cuts then fall to the chunks."""
        found, good = self.align([" ".join(chunks)])
        if not good.all():
            return self.align(chunks)
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)) + 1)
        a_stops, b_stops = (np.searchsorted(ends, stops, "right") for ends in (found.a_ends, found.b_ends))
        return Aligned(found.a, found.a_ends, a_stops, found.b, found.b_ends, b_stops, found.cuts, stops), np.ones(len(chunks), bool)

    def learn(self, chunks: Sequence[str]) -> dict[str, tuple | bool]:
        """Of each chunk, the numbers of tokens of A and B, groups and links, the written groups, the links with their times as bytes.

        False for a chunk without tokens.
        """
        out = {}
        parts: tuple[list[str], list[str]] = [], []
        for chunk in chunks:
            parts[chunk[:1] not in SIGNS or chunk[-1:] not in SIGNS].append(chunk)
        for part, align in zip(parts, (self.align_chunks, self.align)):
            if not part:
                continue
            found, good = align(part)
            codes, times, n_codes = found.links()
            stops, flat = np.cumsum(n_codes).tolist(), np.stack([codes, times], 1).tobytes()
            counts = zip(
                np.diff(found.a_stops, prepend=0).tolist(), np.diff(found.b_stops, prepend=0).tolist(),
                np.diff(found.groups, prepend=0).tolist(), segments(np.array(stops), times).tolist(),
            )
            # Bytes take less memory than arrays and are joined faster; a link and its times are 16.
            for chunk, count, text, i, j, fine in zip(part, counts, self.written(found), [0, *stops[:-1]], stops, good.tolist()):
                out[chunk] = fine and (*count, text, flat[16 * i : 16 * j])
        return out

    def linked(self, texts: Sequence[str | None]) -> list[tuple]:
        """What ``learn`` says of a chunk, for whole texts, with the digest of the written groups; links are distinct."""
        parts = [self.apart(text) if text else [] for text in texts]
        known, older = self.chunks, self.older
        missing = set(chain.from_iterable(parts)).difference(known)
        known.update({c: older[c] for c in missing if c in older})
        if fresh := [c for c in missing if c not in known]:
            # Spans are many small tuples that go with the batch; a search for cycles among them finds none.
            searches = gc.isenabled()
            gc.disable()
            try:
                known.update(self.learn(fresh))
            finally:
                if searches:
                    gc.enable()
        rows = []
        for chunks in parts:
            had = list(map(known.__getitem__, chunks))
            if not had or not all(had):
                rows.append((0, 0, 0, 0, "", _EMPTY, _EMPTY))
                continue
            n_a, n_b, n_groups, n_links, written, codes = zip(*had)
            codes, times = np.frombuffer(b"".join(codes), np.int64).reshape(-1, 2).T
            codes, where = np.unique(codes, return_inverse=True)
            times = np.bincount(where, times).astype(np.int64)
            digest = hashlib.sha256(b";".join(written)).hexdigest()
            rows.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), digest, codes, times))
        for chunk in missing:
            if len(chunk) > MAX_CHUNK_CHARS:
                del known[chunk]
        if len(known) > MAX_CHUNKS:
            self.chunks, self.older = {}, known
        return rows


_EMPTY = np.empty(0, np.int64)


def _mapped(df: DataFrame, a_json: bytes, b_model: bytes, text: str, kinds: dict[str, str], values) -> DataFrame:
    """Replace the column ``text`` by the columns of ``values(aligner, texts)``, one tuple a text."""
    df = df.drop(*[n for n in kinds if n != text])
    digest = hashlib.sha256(a_json + b_model).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast((digest, a_json, b_model))
    kept = [f for f in df.schema if f.name != text]
    types_ = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digest, *files = shared.value
        aligner = held_by_worker("aligner", digest, lambda: Aligner(*files))
        rows = values(aligner, batch.column(batch.schema.get_field_index(text)).to_pylist())
        old = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
        new = [pa.array(column, types_[kind]) for column, kind in zip(zip(*rows), kinds.values())]
        return pa.RecordBatch.from_arrays([*old, *new], names=[*(f.name for f in kept), *kinds])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return map_batches(df, run, ", ".join([*columns, *(f"{n} {k}" for n, k in kinds.items())]), ROWS)


def spans(df: DataFrame, a_json: bytes, b_model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``a_ids``, ``a_ends``, ``b_ids``, ``b_ends`` and ``cuts``, arrays of int; ends are byte offsets in space+text."""

    def values(aligner: Aligner, texts: list[str | None]) -> list[tuple]:
        out = []
        for value in texts:
            found = aligner.align([value])[0] if value else None
            out.append((found.a, found.a_ends, found.b, found.b_ends, found.cuts) if found else (_EMPTY,) * 5)
        return out

    return _mapped(df, a_json, b_model, text, dict.fromkeys(("a_ids", "a_ends", "b_ids", "b_ends", "cuts"), "array<int>"), values)


def linked(df: DataFrame, a_json: bytes, b_model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by the counts and the digest of its groups, its distinct links and how often it holds each.

    New columns: ``n_a, n_b, n_groups, n_links, groups_sha256, links, times``. Columns of these names are replaced.
    """
    kinds = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "links": "array<long>", "times": "array<long>"}
    return _mapped(df, a_json, b_model, text, kinds, lambda aligner, texts: aligner.linked(texts))


def link_counts(rows: DataFrame) -> DataFrame:
    """``(link, docs, best)`` for each link of ``rows(links)``: the rows that hold it, and whether no link of its id of A has more."""
    counts = rows.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("docs"))
    counts = materialize(counts.withColumn("a", F.shiftright("link", B_BITS)), "links")
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return materialize(counts.join(top, "a").select("link", "docs", F.expr("docs = most").alias("best")), "links")


def _common(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links that the most rows hold, at most so many, with their counts and marks, sorted by link."""
    sizes = counts.groupBy("docs").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy(F.desc("docs")))
    least = sizes.withColumn("total", total).filter(F.col("total") <= most).agg(F.min("docs")).first()[0]
    if least is None:
        return _EMPTY, _EMPTY, np.empty(0, bool)
    found = counts.filter(F.col("docs") >= least).toArrow().sort_by("link")
    return tuple(found.column(n).to_numpy() for n in ("link", "docs", "best"))


def score_links(rows: DataFrame, counts: DataFrame, common: int = COMMON_LINKS) -> DataFrame:
    """Replace ``links`` and ``times`` of ``linked`` rows by ``n_best`` and ``count_sum``.

    ``count_sum`` adds up, over all links of the row, how many rows hold the link; ``n_best`` is how many are the most
    frequent ones of their id of A. Links of the most rows are looked up within the task; the rest, of which a row holds
    few, meet their counts in a join. The two add up.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_common(counts, common))
    rows = rows.drop("n_best", "count_sum").withColumn("_row", F.monotonically_increasing_id())
    kept = [f for f in rows.schema if f.name not in ("links", "times")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, docs, best = shared.value
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        links, times = (column(n).flatten().to_numpy(zero_copy_only=False) for n in ("links", "times"))
        sizes = np.diff(column("links").offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
        hit = known[at] == links if len(known) else np.zeros(len(links), bool)
        in_row, at, times_hit = row[hit], at[hit], times[hit]
        total, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        np.add.at(total, in_row, docs[at] * times_hit)
        np.add.at(bests, in_row, best[at] * times_hit)
        left = np.bincount(row[~hit], minlength=len(sizes))
        offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
        rest = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit])) for v in (links, times)]
        names = [f.name for f in kept]
        return pa.RecordBatch.from_arrays(
            [*(column(n) for n in names), pa.array(bests), pa.array(total), *rest],
            names=[*names, "n_best", "count_sum", "_links", "_times"],
        )

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    columns += ", n_best long, count_sum long, _links array<long>, _times array<long>"
    seen = materialize(map_batches(rows, run, columns, 1024), "linked")
    rest = seen.select("_row", F.explode(F.arrays_zip("_links", "_times")).alias("r"))
    rest = rest.select("_row", F.col("r._links").alias("link"), F.col("r._times").alias("times")).join(counts, "link")
    rest = rest.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("docs") * F.col("times")).alias("_sum")
    )
    names = [f.name for f in kept if f.name != "_row"]
    return seen.join(rest, "_row", "left").select(
        *names,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )


def align(df: DataFrame, a_json: bytes, b_model: bytes, text: str = "text") -> DataFrame:
    """All of it: the columns of ``linked`` but for its arrays, with ``n_best`` and ``count_sum`` over all rows."""
    rows = materialize(linked(df, a_json, b_model, text), "linked")
    return score_links(rows, link_counts(rows))
