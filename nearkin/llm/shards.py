"""Sharding by best-fit decreasing.

Groups of equal texts are indivisible. Sorted by size, each enters the shard with the tightest remaining
capacity that holds it, found in a balanced tree of remaining capacities. Groups of one size are alike, so the packing
works on the sizes and their counts, a table of bounded length, and gives runs: so many groups of this size to that
shard. The groups themselves stay in Spark and pick their run by their number within their size.

Shards of a fixed capacity are opened as needed. For a fixed number of shards, the capacity is the smallest that best fit
decreasing needs, searched upwards from an even share; the finest groups, a twentieth of all bytes, go last and to the emptiest
shard, which leaves the shards near equal. A group larger than a shard cannot stay whole: it is cut into parts, of a
shard's size or, for a fixed number of shards, a sixteenth of it. Sizes from 2^20 bytes on count rounded up to 1/1024, which bounds the number of sizes.

Numbers within a size, a group or a shard are dealt by partition of a written table: counts of partitions are summed up and
rows are numbered within theirs, so that no hot key is sorted in one task.

Null texts count as empty. Repeated rows are rows of one group. Extra columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearkin.session import materialize

ROW_BYTES = 16
FINE = 20
# Into how many parts, at least, a group larger than an even share is cut.
PARTS = 16
EXACT_BITS = 20


class Tree:
    """Keys ``(remaining, shard)`` in a treap: balanced by random priorities from a fixed seed."""

    def __init__(self):
        self.root, self.random = None, random.Random(7)

    def add(self, key: tuple[int, int]) -> None:
        low, high = _split(self.root, key)
        self.root = _join(_join(low, [key, self.random.random(), None, None]), high)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the least key with at least ``size`` remaining; of equals the lowest shard."""
        low, high = _split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        path, node = [], high
        while node[2] is not None:
            path.append(node)
            node = node[2]
        if path:
            path[-1][2] = node[3]
        else:
            high = node[3]
        self.root = _join(low, high)
        return node[0]

    def pop_emptiest(self) -> tuple[int, int]:
        path, node = None, self.root
        while node[3] is not None:
            path, node = node, node[3]
        if path is None:
            self.root = node[2]
        else:
            path[3] = node[2]
        return node[0]

    def most(self) -> int | None:
        node = self.root
        while node is not None and node[3] is not None:
            node = node[3]
        return node[0][0] if node else None


def _split(node, key):
    """Nodes below ``key`` and the others."""
    if node is None:
        return None, None
    if node[0] < key:
        low, high = _split(node[3], key)
        node[3] = low
        return node, high
    low, high = _split(node[2], key)
    node[2] = high
    return low, node


def _join(low, high):
    if low is None or high is None:
        return low or high
    if low[1] > high[1]:
        low[3] = _join(low[3], high)
        return low
    high[2] = _join(low, high[2])
    return high


Run = tuple[int, int, int, int]


def best_fit(sizes: list[tuple[int, int]], capacity: int, shards: int | None = None) -> tuple[list[Run], dict[int, int]] | None:
    """Runs ``(size, first, end, shard)`` and the capacity each shard has left; ``sizes`` are ``(size, count)``, largest first.

    Without ``shards`` new ones are opened as needed; otherwise None stands for no fit.
    """
    tree, runs, left = Tree(), [], {}
    for shard in range(shards or 0):
        tree.add((capacity, shard))
        left[shard] = capacity
    for size, count in sizes:
        done = 0
        while done < count:
            found = tree.pop_tightest(size)
            if found is None:
                if shards is not None:
                    return None
                found = (max(capacity, size), len(left))
            remaining, shard = found
            many = min(count - done, remaining // size)
            runs.append((size, done, done + many, shard))
            left[shard] = remaining - many * size
            tree.add((left[shard], shard))
            done += many
    return runs, left


def even_shards(sizes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs for a fixed number of shards of near equal size."""
    total = sum(size * count for size, count in sizes)
    # The finest sizes, whole ones only, that make up a twentieth at most.
    fine, cut = 0, len(sizes)
    while cut and (fine + sizes[cut - 1][0] * sizes[cut - 1][1]) * FINE <= total:
        cut -= 1
        fine += sizes[cut][0] * sizes[cut][1]
    share, low, room = -(-(total - fine) // shards), -1, 0
    while (packed := best_fit(sizes[:cut], share + room, shards)) is None:
        low, room = room, max(1, room * 2)
    # The fit lies between the last two tries.
    while room - low > 1 + (room >> 4):
        middle = (low + room) // 2
        if (found := best_fit(sizes[:cut], share + middle, shards)) is None:
            low = middle
        else:
            packed, room = found, middle
    runs, left = packed
    tree = Tree()
    for shard, remaining in left.items():
        tree.add((remaining, shard))
    for size, count in sizes[cut:]:
        done = 0
        while done < count:
            remaining, shard = tree.pop_emptiest()
            ahead = (remaining - tree.most()) // size if shards > 1 else count
            many = min(count - done, max(1, ahead, (count - done) // shards))
            runs.append((size, done, done + many, shard))
            tree.add((remaining - many * size, shard))
            done += many
    return runs


def _numbered(df: DataFrame, by: list[str], out: str) -> DataFrame:
    """``df``, a written table with a row id ``rid``, and each row's number within ``by``, from 0."""
    parts = df.withColumn("pid", F.shiftright("rid", 33))
    counts = parts.groupBy(*by, "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = F.row_number().over(Window.partitionBy(*by, "pid").orderBy("rid")) - 1
    return parts.withColumn("here", here).join(offsets, [*by, "pid"]).withColumn(
        out, (F.col("offset") + F.col("here")).cast("long")
    ).drop("pid", "here", "offset")


def _with_rid(df: DataFrame, name: str) -> DataFrame:
    return materialize(df.withColumn("rid", F.monotonically_increasing_id()), name)


def shard(df: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` of each row: for ``shards`` shards of even size, or shards of ``capacity`` bytes."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either the number of shards or their capacity")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = _with_rid(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.sha2(body, 256).alias("key"),
        ),
        "rows",
    )
    groups = materialize(
        rows.groupBy("key").agg(F.max("size").alias("size"), F.count("*").alias("n")), "groups"
    )
    total = groups.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    most = capacity or max(1, -(-total // shards))
    # Parts of an even share would leave no room to even out the shards.
    part = capacity or max(1, most // PARTS)
    per_part = F.greatest(F.floor(F.lit(part) / F.col("size")), F.lit(1))
    per_part = F.when(F.col("size") * F.col("n") > most, per_part).otherwise(F.col("n")).cast("long")
    groups = groups.withColumn("per_part", per_part)
    part_rows = F.least(F.col("per_part"), F.col("n") - F.col("part") * F.col("per_part"))
    items = groups.withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("per_part")) - 1))
    ).withColumn("bytes", F.col("size") * part_rows)
    step = F.pow(F.lit(2), F.greatest(F.floor(F.log2("bytes")) - 10, F.lit(EXACT_BITS - 10))).cast("long")
    rounded = F.when(F.col("bytes") < 1 << EXACT_BITS, F.col("bytes")).otherwise(F.ceil(F.col("bytes") / step) * step)
    items = _with_rid(items.select("key", "part", "per_part", rounded.cast("long").alias("bytes")), "items")
    # At most 2^20 sizes and 1,024 for each power of two beyond.
    sizes = [(r["bytes"], r["n"]) for r in items.groupBy("bytes").agg(F.count("*").alias("n")).collect()]
    sizes.sort(reverse=True)
    runs = even_shards(sizes, shards) if shards else best_fit(sizes, capacity)[0]
    spark = df.sparkSession
    dealt = spark.createDataFrame(runs or [], "bytes bigint, first bigint, end bigint, shard bigint").groupBy("bytes").agg(
        F.array_sort(F.collect_list(F.struct("first", "end", "shard"))).alias("runs")
    )
    own = F.filter("runs", lambda r: (r["first"] <= F.col("number")) & (F.col("number") < r["end"]))
    placed = materialize(
        _numbered(items, ["bytes"], "number").join(dealt, "bytes").select(
            "key", "part", "per_part", F.get(own, 0)["shard"].cast("int").alias("shard")
        ),
        "placed",
    )
    # Only the rows of cut groups need a number within their group.
    cut = placed.filter("part > 0").select("key", "per_part").distinct()
    whole = rows.join(cut, "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
    split = _numbered(materialize(rows.join(cut, "key"), "cut"), ["key"], "number").withColumn(
        "part", F.floor(F.col("number") / F.col("per_part")).cast("long")
    )
    columns = ["rid", "id", "size", "text_crc32", "key", "part"]
    found = whole.select(*columns).unionByName(split.select(*columns)).join(
        placed.select("key", F.col("part").cast("long").alias("part"), "shard"), ["key", "part"]
    )
    return _numbered(materialize(found, "sharded"), ["shard"], "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot"
    )
