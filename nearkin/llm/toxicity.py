"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text, one on toxic text. A window, one word and the space on
either side of it, is compressed with the ordinary dictionary alone and with the toxic one added; a window that the toxic
text explains gets shorter. So that short matches show in whole bytes, every byte is written as a fixed code of
three. What a pair of lengths says is calibrated on labelled documents as a log-likelihood ratio, and a document's score
comes from a logistic fit on its three most telling windows.

Documents carry the labels, not passages: the toxic dictionary is trained on those words of toxic documents that
ordinary ones have clearly less often, counted once per document and once per group of near copies.

The fit sees a bounded sample of labelled rows (``MAX_TOXIC``, ``MAX_ORDINARY``, ``MAX_FIT_BYTES``); scores see every word
of every text. Null and empty texts get the score of a text without telling windows. Without a labelled row of
each class every score is 0. Rows without a label, or with several, don't take part in the fit. Extra columns stay.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.words import byte_texts, map_batches, mix, plain_words, shingle_hashes

# Rows of each class the fit may see, and the longest text it takes.
MAX_TOXIC, MAX_ORDINARY, MAX_FIT_BYTES = 2500, 5000, 32_768
ORDINARY_BYTES, TOXIC_BYTES = 60_000, 3_000
LEVEL = 19
CODE = 3
# Words longer than this are cut into overlapping windows.
MAX_WORD = 48
# How many standard errors apart a word's shares in the two classes must lie.
TELLING = 5.0
BEGINNINGS = (4, 5, 6)
TOP = 3
# Remembered words of a task; when full, they are dropped and built anew.
MAX_WORDS = 300_000

_CODES = (lambda r: [bytes(r.randrange(256) for _ in range(CODE)) for _ in range(256)])(random.Random(3))


def expand(text: bytes) -> bytes:
    return b"".join(map(_CODES.__getitem__, text))


def windows(words: Iterable[bytes]) -> Iterable[bytes]:
    for word in words:
        if len(word) <= MAX_WORD:
            yield word
        else:
            for start in range(0, len(word) - MAX_WORD // 2, MAX_WORD // 2):
                yield word[start : start + MAX_WORD]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    ratios: dict[tuple[int, int, int], float]
    weights: tuple[float, ...]


class Gauge(dict):
    """The calibrated log-likelihood ratio of each window; a missing one is compressed and kept."""

    def __init__(self, model: Model):
        self.ratios = model.ratios
        self.plain = _compressor(model.ordinary)
        self.added = _compressor(model.ordinary + model.toxic)

    def cell(self, word: bytes) -> tuple[int, int, int]:
        """Length of the word, bytes the toxic dictionary saves, bytes left with it."""
        window = expand(b" " + word + b" ")
        added = len(self.added.compress(window))
        return min(len(word), 16), len(self.plain.compress(window)) - added, added // 2

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = self.ratios.get(self.cell(word), 0.0)
        return value

    def features(self, words: Iterable[bytes]) -> list[float]:
        """The largest ratios of a text's distinct windows, never below 0."""
        best = sorted((v for v in map(self.__getitem__, set(windows(words))) if v > 0), reverse=True)[:TOP]
        return best + [0.0] * (TOP - len(best))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(expand(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def _content(samples: list[bytes], size: int, **how: int) -> bytes:
    """The text zstandard's trainer picks from the samples; where they are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _complete(content: bytes, samples: list[bytes], size: int) -> bytes:
    """The content and the most frequent samples that the trainer left out, to at most twice the size."""
    left = [s for s, _ in Counter(samples).most_common() if s not in content]
    return b"".join(left)[:size] + content


def _without_copies(texts: Iterable[bytes]) -> list[list[bytes]]:
    """Words of texts, one text of each group that shares one of five MinHash values of its 3-word shingles."""
    seen: set[tuple[int, int]] = set()
    # One object for all the places of a word.
    known: dict[bytes, bytes] = {}
    kept = []
    for text in texts:
        words = plain_words(text)
        if not words:
            continue
        hashes = shingle_hashes(words, 3)
        values = {(i, int(mix(hashes ^ np.uint64(i)).min())) for i in range(5)}
        if not values & seen:
            kept.append([known.setdefault(word, word) for word in words])
        seen |= values
    return kept


def _traits(word: bytes) -> list[bytes]:
    """The word between its spaces and its beginnings."""
    return [b" " + word + b" ", *(b" " + word[:n] for n in BEGINNINGS if n < len(word))]


def _telling(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words of toxic documents that ordinary ones have less often, or that begin like such words."""
    one = Counter(t for d in toxic for t in {t for w in set(windows(d)) for t in _traits(w)})
    # Only traits of toxic documents are asked for.
    other = Counter(t for d in ordinary for t in {t for w in set(windows(d)) for t in _traits(w)} & one.keys())
    n, m = len(toxic), len(ordinary)

    def apart(trait: bytes) -> float:
        share = (one[trait] + other[trait]) / (n + m)
        return (one[trait] / n - other[trait] / m) / math.sqrt(share * (1 - share) * (1 / n + 1 / m) or 1)

    scores = {trait: apart(trait) for trait, count in one.items() if count > 2}
    found = {trait for trait, score in scores.items() if score > TELLING and other[trait] * n < one[trait] * m / 10}
    # With few labelled rows none is that sure: the ones furthest apart have to do.
    found = found or set(sorted(scores, key=lambda t: (-scores[t], t))[:20])
    return {w for d in toxic for w in windows(d) if not found.isdisjoint(_traits(w))}


def fit(texts: list[bytes], labels: list[int], share: float) -> Model | None:
    """A model from labelled texts; ``share`` is the share of toxic rows among all labelled ones."""
    sample = list(zip(texts, labels))
    toxic = _without_copies(t for t, y in sample if y == 1)
    ordinary = _without_copies(t for t, y in sample if y == 0)
    if not toxic or not ordinary:
        return None
    telling = _telling(toxic, ordinary)
    plain = _content(list(_pieces(ordinary)), ORDINARY_BYTES)
    samples = [b" " + w + b" " for d in toxic for w in windows(d) if w in telling]
    added = _complete(_content(samples, TOXIC_BYTES, k=16, d=6), samples, TOXIC_BYTES)
    gauge = Gauge(Model(plain, added, {}, ()))
    cells: dict[bytes, tuple[int, int, int]] = {}
    seen = [Counter(), Counter()]
    for y, group in ((1, toxic), (0, ordinary)):
        for words in group:
            own = set(windows(words))
            cells.update((w, gauge.cell(w)) for w in own if w not in cells)
            seen[y].update({cells[w] for w in own})
    cells.clear()
    n, m = len(toxic), len(ordinary)
    ratios = {
        c: math.log((seen[1][c] + 0.5) / (n + 1)) - math.log((seen[0][c] + 0.5) / (m + 1)) for c in {*seen[0], *seen[1]}
    }
    gauge = Gauge(Model(plain, added, ratios, ()))
    x = np.array([[1.0, *gauge.features(words)] for group in (toxic, ordinary) for words in group])
    y = np.array([1.0] * n + [0.0] * m)
    weight = np.where(y == 1, share / n, (1 - share) / m) * len(y)
    return Model(plain, added, ratios, tuple(map(float, _logistic(x, y, weight))))


def _pieces(texts: list[list[bytes]]) -> Iterable[bytes]:
    """Texts cut into pieces of a size the trainer takes."""
    for words in texts:
        text = b" " + b" ".join(words) + b" "
        for start in range(0, len(text), 256):
            yield text[start : start + 256]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, keep=None, id_col: str = "doc_id", label: str = "toxic") -> Model | None:
    """Fit on the rows of ``docs`` that ``labels`` marks once; ``keep``, a condition on the id, narrows them.

    The sample is drawn from the labels by hash of the id, so of the texts only its few thousand are gathered.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.filter(keep) if keep is not None else known
    known = known.groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("other")).filter("y = other")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    order = [F.xxhash64(id_col), F.col(id_col)]
    sample = known.filter("y = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(
        known.filter("y = 0").orderBy(*order).limit(MAX_ORDINARY)
    )
    # The sample's ids are bounded, the texts stay where they are.
    rows = (
        docs.filter(F.octet_length("text") <= MAX_FIT_BYTES)
        .select(id_col, "text")
        .join(F.broadcast(sample.select(id_col, "y")), id_col)
        .groupBy(id_col)
        .agg(F.min("text").alias("text"), F.min("y").alias("y"))
        .orderBy(*order)
        .collect()
    )
    texts, marks = [r["text"].encode() for r in rows], [r["y"] for r in rows]
    # The driver holds each text once.
    del rows
    return fit(texts, marks, counts[1] / (counts[0] + counts[1]))


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``df`` and the score, 0 to 1; a column of its name is replaced."""
    df = df.drop(out)
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    # Plain values: a broadcast is read without this module.
    shared = df.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic, model.ratios, model.weights))
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            known = Model(*shared.value)
            state.extend((Gauge(known), np.array(known.weights)))
        gauge, weights = state
        texts = byte_texts(batch.column(batch.schema.get_field_index(text)))
        x = np.array([[1.0, *gauge.features(plain_words(t))] for t in texts])
        values = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` double"])
    return map_batches(df, run, schema)
