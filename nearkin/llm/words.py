"""Words and word shingles of whole texts as numpy arrays; helpers of the operators that work on Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

SHINGLE = 5
# Odd multipliers of the mixing steps.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

# ASCII letters and digits and every byte of a non-ASCII character stay, A-Z in lower case; the rest separates words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> np.uint64(32))) * MIX[0]
    values = (values ^ (values >> np.uint64(29))) * MIX[1]
    return values ^ (values >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words; the whole sequence as one where there are fewer; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    hashed = word_hashes(words)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out ^ hashed[i : n + i])
    return out


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or b"").lower().split()


def plain_words(text: bytes | None) -> list[bytes]:
    """Words of letters and digits: every ASCII sign separates, A-Z in lower case."""
    return (text or b"").translate(WORD_BYTES).split()


def held_by_worker(name: str, key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for the key when this Python worker first asked; it outlives a task. One key a name is held."""
    module = sys.modules.setdefault("_nearkin_held", types.ModuleType("_nearkin_held"))
    found = module.__dict__.setdefault(name, {})
    if key not in found:
        found.clear()
        found[key] = make()
    return found[key]


def byte_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


# Rows that Spark sends to a worker at a time, at most; an Arrow batch of long texts is held on both sides.
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256
) -> DataFrame:
    """``fn`` over slices of at most ``rows`` rows, so that a task holds little beside the batch it was sent.

    The session's bound on the rows of a batch is lowered to ``BATCH_ROWS`` where it is higher or off.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
