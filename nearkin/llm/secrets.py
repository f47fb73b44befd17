"""Secrets: fixed forms of keys and passwords, and strings that a battery of tests takes for random.

The fixed forms are an assignment to a telling name, an access key and a run of hex digits. Beside them, every run of key
characters long enough is a candidate, without its parts in fixed forms; with hex digits inside, also as a whole. A run that
fits no alphabet is cut at its signs: names before ``=``, folders and the like are pieces of their own. A candidate's encoding is inferred from its characters, and three tests ask whether it
looks drawn evenly from that alphabet: chi-squared of the character counts, the number of runs above and below
the middle of the alphabet, and the correlation of neighbours. The same statistics under ordinary text have a wider
spread that grows with the length, by the uneven letter shares counted over all texts; the chance of a value this even
under ordinary text is the candidate's p-value, and short strings cannot get a small one. Benjamini-Hochberg over
all candidates, in classes of length, decides which are reported, provided the uniform hypothesis holds up too.

Counts of letters and of p-values are combined over all texts; only these bounded tables reach the driver.

Spans count code points, the end exclusive. Null texts are empty. Repeated rows stay, extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.words import byte_texts, map_batches

# Fixed forms, in the order of ties.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("passw", "secret", "token", "api_key", "apikey")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
# Cuts of what holds signs of both base64 alphabets: one's signs, the other's, and all; a key may hold either.
PIECES = tuple(map(re.compile, (r"[^+/]+", r"[^_-]+", r"[^+/_-]+")))
# Alphabets by name, each in its own order; a candidate has the first that holds all its characters.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
LETTERS = tuple(map(set, ALPHABETS.values()))
# False-discovery rate, least p-value of the uniform hypothesis, and classes of p-values (tenths of a power of ten).
RATE = 0.01
EVEN = 1e-4
P_CLASSES = 400
LENGTH_CLASSES = (20, 28, 40, 64)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the fixed forms."""
    lower = text.lower()
    spans = []
    if any(name in lower for name in NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def encoding(token: str) -> str | None:
    """The alphabet of a candidate; padding at the end doesn't count. None for pure words of letters in one case."""
    chars = set(token.rstrip("="))
    if not chars or (not any(c.isdigit() for c in chars) and (token.islower() or token.isupper() or token.istitle())):
        return None
    return next((name for name, letters in ALPHABETS.items() if chars <= set(letters)), None)


def _cut(text: str, start: int, end: int) -> set[tuple[int, int]]:
    """The span where it fits an alphabet, else its pieces that do; none shorter than ``LEAST``. Padding stays at the end."""
    body = text[start:end].rstrip("=")
    found = set()
    for named in re.finditer("[^=]+", body):
        spans = [named.span()]
        if not any(set(named[0]) <= letters for letters in LETTERS):
            spans = [(named.start() + m.start(), named.start() + m.end()) for p in PIECES for m in p.finditer(named[0])]
        found.update((start + a, end if b == len(body) else start + b) for a, b in spans)
    return {(a, b) for a, b in found if b - a >= LEAST}


def candidates_of(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans to test: the runs of key characters without their parts in ``taken``, the fixed forms.

    A run of hex digits may as well be part of a longer key, so what surrounds it is a candidate with it, too.
    """
    out = []
    # Runs and fixed forms are gone through side by side: spans of a kind don't overlap, so few reach beyond a run.
    ahead, at_hand = iter(sorted(taken)), []
    following = next(ahead, None)
    for run in CANDIDATE.finditer(text):
        at_hand = [s for s in at_hand if s[1] > run.start()]
        while following and following[0] < run.end():
            if following[1] > run.start():
                at_hand.append(following)
            following = next(ahead, None)
        met = at_hand
        hexes = {s[:2] for s in met if s[2] == "hex"}
        found = set()
        for without in (met, [s for s in met if s[2] != "hex"]) if hexes else (met,):
            at = run.start()
            for a, b, _ in [*without, (run.end(), run.end(), "")]:
                if at < a:
                    found |= _cut(text, at, a)
                at = max(at, b)
        out += sorted(found - hexes)
    return out


def _tail(z: float) -> float:
    """Chance that a normal value lies above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, name: str, shares: dict[str, float]) -> tuple[float, float]:
    """``(p_text, p_even)`` of a candidate.

    ``p_text``: the chance that ordinary text of this length and letter ``shares`` is as even as this or more.
    ``p_even``: the least of the three tests' chances under evenly drawn characters, for three tests.
    """
    letters = ALPHABETS[name]
    place = {c: i for i, c in enumerate(letters)}
    x = np.array([place[c] for c in token.rstrip("=")])
    n, k = len(x), len(letters)
    counts = np.bincount(x, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # Chi-squared by the cube-root approximation.
    df = k - 1
    z_chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = x >= k / 2
    ups = int(high.sum())
    downs = n - ups
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * ups * downs / n + 1
    spread = math.sqrt(max((mean - 1) * (mean - 2) / max(n - 1, 1), 1e-9))
    z_runs = (runs - mean) / spread if ups and downs else -math.sqrt(n)
    centred = x - x.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    z_serial = (serial + 1 / n) * math.sqrt(n)
    p_even = min(1.0, 3 * min(_tail(z_chi), 2 * _tail(abs(z_runs)), 2 * _tail(abs(z_serial))))
    # Under text the statistic has a noncentral spread: each unit of length adds the unevenness of its letters.
    share = np.array([shares.get(c, 0.0) for c in letters])
    total = share.sum()
    uneven = float(((share / total - 1 / k) ** 2).sum() * k) if total else 1.0
    bent = n * uneven
    z_text = (chi - (df + bent)) / math.sqrt(2 * (df + 2 * bent))
    # Words leave half of a mixed alphabet unused: the share of digits and case changes is weighed in.
    kinds = [c.isdigit() + 2 * c.isupper() for c in token.rstrip("=")]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
    z_kind = (changes - 0.05) * math.sqrt(n) / math.sqrt(0.05 * 0.95)
    return _tail(max(0.0, -z_text) + max(0.0, z_kind) / 2), p_even


def _p_class(p: float) -> int:
    """Tenths of a power of ten below 1, rounded to the less sure side."""
    return min(P_CLASSES - 1, int(-10 * math.log10(max(p, 1e-300))))


def _length_class(n: int) -> int:
    return sum(n >= low for low in LENGTH_CLASSES)


def letter_shares(df: DataFrame, text: str) -> dict[str, float]:
    """Shares of ASCII letters and digits over all texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = b"".join(t for t in byte_texts(batch.column(0)) if t)
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=128)[:128]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(128), pa.int32()), pa.array(counts, pa.int64())], names=["c", "n"]
        )

    rows = map_batches(df.select(text), run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()
    counts = {chr(r["c"]): r["n"] for r in rows if chr(r["c"]).isalnum()}
    total = sum(counts.values()) or 1
    return {c: n / total for c, n in counts.items()}


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per length class the least p-class that Benjamini-Hochberg accepts at ``rate``, from counts of classes.

    Each class of length is held to the rate on its own: its many short words don't hide a few long keys.
    """
    counts: dict[int, Counter] = {}
    for r in candidates.groupBy("length_class", "p_class").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["length_class"], Counter())[r["p_class"]] += r["n"]
    found = {}
    for length, classes in counts.items():
        total, above = sum(classes.values()), 0
        for p in range(P_CLASSES - 1, -1, -1):
            above += classes[p]
            # The least sure value of a class stands for all of it.
            if classes[p] and 10 ** (-p / 10) * total <= rate * above:
                found[length] = p
    return found


def find_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """All columns of ``df`` and ``secrets``, an array of ``(kind, start, end)`` by start, then kind.

    A column of that name is replaced. Random spans don't overlap each other; one may hold or touch a hex span.
    """
    df = df.drop("secrets")
    shares = df.sparkSession.sparkContext.broadcast(letter_shares(df, text))

    def tests(value: str, skip: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int, bool]]:
        out = []
        for start, end in candidates_of(value, skip):
            token = value[start:end]
            name = encoding(token)
            if name:
                p, even = battery(token, name, shares.value)
                out.append((start, end, _length_class(len(token)), _p_class(p), even >= EVEN))
        return out

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [t for v in batch.column(0).to_pylist() if v for t in tests(v, base_spans(v))]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int32()) for i in (2, 3)], names=["length_class", "p_class"]
        )

    limits = thresholds(map_batches(df.select(text), measure, "length_class int, p_class int"), rate)
    sent = df.sparkSession.sparkContext.broadcast(limits)
    order = {kind: i for i, kind in enumerate(KINDS)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
            spans = base_spans(value or "")
            extra: list[tuple[int, int, str]] = []
            for a, b, length, p, even in sorted(tests(value or "", spans)):
                if even and p >= sent.value.get(length, P_CLASSES):
                    # Pieces that overlap are one secret.
                    if extra and a < extra[-1][1]:
                        a, b = extra[-1][0], max(b, extra.pop()[1])
                    extra.append((a, b, "random"))
            spans = sorted(spans + extra, key=lambda s: (s[0], order[s[2]]))
            found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "secrets"])

    schema = ", ".join(
        [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "secrets array<struct<kind: string, start: bigint, end: bigint>>"]
    )
    return map_batches(df, run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with each span of ``secrets`` in ``text`` replaced by ``mark``, without the column ``secrets``.

    Overlapping spans are replaced as one.
    """

    def cut(value: str, spans: list[dict]) -> str:
        out, at = [], 0
        for span in spans:
            if span["start"] >= at:
                out += [value[at : span["start"]], mark]
            at = max(at, span["end"])
        return "".join([*out, value[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = [n for n in batch.schema.names if n != "secrets"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        at = names.index(text)
        spans = batch.column(batch.schema.get_field_index("secrets")).to_pylist()
        columns[at] = pa.array([cut(v, s) if s else v for v, s in zip(columns[at].to_pylist(), spans)], columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=names)

    kept = [f for f in df.schema if f.name != "secrets"]
    return map_batches(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))
