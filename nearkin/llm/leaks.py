"""Benchmark decontamination: passages of documents that repeat a benchmark item, wholly or nearly.

Words are runs of letters and digits (every ASCII sign separates), in lower case. For an item of ``n`` words, windows of
``n`` words of a document are compared by a 64-bit SimHash of their word shingles. Fingerprints are cut into
``RADIUS + 1`` blocks; two within the radius agree in one block at least, so a join on (window size, block, value) finds every one
of them. What it finds is held to the exact weighted similarity of the shingle bags, ``sum(min) / sum(max)`` of
their counts.

Windows start at every word. The similarity ignores order, so one that passes may hold its item's shingles anywhere, but it
must hold enough of them: a shared part of ``percent * (window + item) / (100 + percent)``. The corpus goes through one probe
for shingles of items; counts along a document's hits then give every start with as many, and only these windows
are fingerprinted. No texts are shuffled, only the shingles of documents with a hit.

Everything is built from DataFrame functions. Items are deduplicated by their words; the table of their shingles is
broadcast only below ``BROADCAST_ROWS`` rows, beyond which both sides are shuffled and Spark splits common shingles.

Cases: null and empty texts hold nothing; items without words are left out; an item of fewer words than a shingle is one
shingle. Rows that share an id are one document. Null ids are a document of their own. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.words import SHINGLE
from nearkin.session import materialize

RADIUS = 20
BITS = 64
# Items' shingle rows that may be broadcast: some 24 bytes each.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    spaced = F.regexp_replace(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingles(tokens: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, in order; none where there are fewer."""
    # Words are taken one by one: a slice inside a lambda would copy the whole text each time.
    starts = F.sequence(F.lit(0), F.size(tokens) - k)
    runs = F.transform(starts, lambda i: F.xxhash64(*(F.get(tokens, i + j) for j in range(k))))
    return F.when(F.size(tokens) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``keys``, the array ``hashes`` and its SimHash ``print``: bit by bit the majority of the shingles' hashes."""
    # Each bit is counted on its own, so that no count of shingles is too large.
    ones = lambda b: F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)) == 1))
    bit = lambda b: F.call_function("shiftleft", (ones(b).cast("long") * 2 > F.size(hashes)).cast("long"), b)
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda found, b: found.bitwiseOR(bit(b))
    )
    return rows.select(*keys, hashes, bits.alias("print"))


def blocks(print_: str, radius: int = RADIUS) -> Column:
    """``radius + 1`` numbered pieces of a fingerprint, each as one number."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *(
            F.shiftrightunsigned(print_, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) * (radius + 1) + i
            for i, (low, high) in enumerate(zip(cuts, cuts[1:]))
        )
    )


def bag_similarity(a: str, b: str) -> Column:
    """``sum(min) / sum(max)`` of the counts of two bags."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    both = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda total, x: total + F.least(count(F.col(a), x), count(F.col(b), x))
    )
    return both / (F.size(a) + F.size(b) - both)


def _starts(hits: Column, size: Column, m: Column, percent: int) -> Column:
    """Starts of all windows of ``m`` shingles, cut off at the borders of a document of ``size`` shingles, that may pass.

    ``hits`` are the ascending places of shingles that items of this length hold. Negative starts lie before the document.
    """

    def need(window: Column) -> Column:
        """Shared shingles, at least, of a window that passes."""
        return F.greatest(F.ceil((window + m) * percent / (100 + percent) - 1e-6).cast("int"), F.lit(1))

    # No window holds fewer than the items' share of the least one allowed.
    fewest = F.greatest(F.ceil(m * percent / 100 - 1e-6).cast("int"), F.lit(1))

    def passing(first: Column, i: Column) -> Column:
        """Starts above the hit before ``first``, the hit numbered ``i``, up to it: their windows' first hit is this one."""
        before = F.coalesce(F.get(hits, F.when(i > 0, i - 1)), -m)
        low = F.greatest(before + 1, F.get(hits, i + fewest - 1) - m + 1)
        inside = lambda s: F.least(s + m, size) - F.greatest(s, F.lit(0))
        enough = lambda s: F.coalesce(F.get(hits, i + need(inside(s)) - 1) < s + m, F.lit(False))
        whole = F.get(hits, i + fewest - 1).isNotNull() & (low <= first)
        return F.when(whole, F.filter(F.sequence(low, F.greatest(low, first)), enough)).otherwise(
            F.array().cast("array<int>")
        )

    return F.flatten(F.transform(hits, passing))


def _windows(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """``(doc, body, start, n, k, hashes)`` for every window with as many shingles of items as it needs to pass."""
    item_rows = items.filter(F.col("k") == k).select("n", F.explode(shingles(F.col("tokens"), k)).alias("h")).distinct()
    item_rows = materialize(item_rows, "item_shingles")
    small = item_rows.count() <= BROADCAST_ROWS
    body = docs.select("doc", "body", shingles(F.col("tokens"), k).alias("all"))
    # The outer form keeps Spark from testing the array, and with it the whole tokenization, in a filter below.
    hits = body.select("doc", "body", *(["all"] if small else []), F.posexplode_outer("all").alias("pos", "h")).join(
        F.broadcast(item_rows) if small else item_rows, "h"
    )
    whole = [F.first("all").alias("all")] if small else []
    found = hits.groupBy("doc", "body", "n").agg(F.array_sort(F.collect_set("pos")).alias("hits"), *whole)
    if not small:
        # The places alone are shuffled; the texts are met again by id.
        found = found.join(body, (found.doc.eqNullSafe(body.doc)) & (found.body == body.body)).select(
            found.doc, found.body, "n", "hits", "all"
        )
    m = F.col("n") - (k - 1)
    starts = found.select("doc", "body", "n", "all", F.explode(_starts(F.col("hits"), F.size("all"), m, percent)).alias("start"))
    first = F.greatest(F.col("start"), F.lit(0))
    last = F.least(F.col("start") + m, F.size("all"))
    return starts.select(
        "doc", "body", "start", "n", F.lit(k).alias("k"), F.slice("all", first + 1, last - first).alias("hashes")
    )


def _in_place(start: Column, window: str, item: str) -> Column:
    """How many shingles of a window stand where its item has them; a negative start cuts off the item's first ones."""
    same = F.zip_with(
        F.col(window), F.slice(item, F.greatest(-start, F.lit(0)) + 1, F.size(window)), lambda a, b: F.equal_null(a, b)
    )
    return F.size(F.filter(same, lambda x: x))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text: str = "text",
    percent: int = 80,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``(id, item, start, n_words, distance, similarity)``: the best window of each document and item it repeats.

    ``start`` is the window's first word, from 0; it is negative where the document begins within the item. Among equally
    similar windows the one with most shingles in their places counts, then the first.
    """
    named = benchmark.select(F.col(item_col).alias("item"), words(F.col(text)).alias("tokens"))
    named = named.filter(F.size("tokens") > 0).withColumn("key", F.xxhash64("tokens")).distinct()
    items = (
        named.groupBy("key")
        .agg(F.first("tokens").alias("tokens"))
        .withColumn("n", F.size("tokens"))
        .withColumn("k", F.least("n", F.lit(shingle)))
    )
    items = materialize(items, "items")
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("body"), words(F.col(text)).alias("tokens"))
    out = None
    # At most as many lengths as a shingle has words.
    for k in [r["k"] for r in items.select("k").distinct().collect()] or [shingle]:
        windows = fingerprints(_windows(texts, items, k, percent), ["doc", "body", "start", "n", "k"], "hashes")
        known = items.filter(F.col("k") == k).select("key", "n", shingles(F.col("tokens"), k).alias("item_hashes"))
        known = fingerprints(known, ["key", "n"], "item_hashes").withColumnRenamed("print", "item_print")
        windows, known = materialize(windows, "windows"), materialize(known, "prints")
        met = (
            windows.withColumn("block", F.explode(blocks("print")))
            .join(known.withColumn("block", F.explode(blocks("item_print"))), ["n", "block"])
            .withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))))
            .filter(F.col("distance") <= RADIUS)
            .dropDuplicates(["doc", "body", "start", "key"])
            .withColumn("similarity", bag_similarity("hashes", "item_hashes"))
            .filter(F.col("similarity") * 100 >= percent)
            .withColumn("in_place", _in_place(F.col("start"), "hashes", "item_hashes"))
            .select("doc", "start", "n", "key", "distance", "similarity", "in_place")
        )
        out = met if out is None else out.unionByName(met)
    best = out.groupBy("doc", "key").agg(
        F.max_by(
            F.struct("start", "n", "distance", "similarity"), F.struct("similarity", "in_place", -F.col("start"))
        ).alias("best")
    )
    return best.join(named.select("key", "item"), "key").select(
        F.col("doc").alias(id_col),
        F.col("item").alias(item_col),
        F.col("best.start").cast("long").alias("start"),
        F.col("best.n").cast("long").alias("n_words"),
        F.col("best.distance").alias("distance"),
        F.col("best.similarity").alias("similarity"),
    )
