"""Mix sources to target weights by systematic sampling; DataFrame functions only.

Targets share a part of all sizes by the sources' weights. No target exceeds ``cap`` times its source; what is too much
is shared out again among the others. Within a source every document is expected equally often, ``target / source_size``
times: the expected copies are summed up over its documents in order of size, one offset drawn from the seed is added,
and a document is taken once for each whole number that its part of the sum crosses. In this order the words taken differ
from the target by less than about the longest document of the source.

Places within a source come from counts of small bins (size class and leading bits of a digest), so no source passes
through one task, however large. Only one row per source does. The outcome depends on the rows and the seed alone.

A null source is a source of its own, after all others. Null sizes count 0; a source without words has the target 0 and is
not taken. Rows that repeat are documents of their own. Tables without rows give none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
# Rows of a bin, about; a bin is ordered in one task.
BIN_ROWS = 2000


def word_count(text: str | Column) -> Column:
    """Words between ASCII white space; null texts have none. Counted by their starts, without an array of words."""
    spaced = F.concat(F.lit(" "), F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    starts = F.regexp_replace(spaced, r"[\x20\x09-\x0D][^\x20\x09-\x0D]", "")
    return F.floor((F.char_length(spaced) - F.char_length(starts)) / 2).cast("long")


def _unit(text: Column) -> Column:
    """A number between 0 and 1 that a text stands for, of so few digits that sums with whole numbers are exact."""
    return (F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("double") + 0.5) / 65536


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes(source, source_size)``, a row per source, with ``weight`` and ``target``.

    Weights go to the sources in order of their code points, null last, and start again when used up.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("_most", cap * F.col("source_size").cast("double"))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rows = rows.withColumns({"_total": F.sum(F.col("source_size").cast("double")).over(everything) * share, "_weights": F.sum("weight").over(everything)})
    none = F.lit(0.0)
    left = F.col("_total") - F.coalesce(F.sum("_most").over(before), none)
    left_weights = F.col("_weights") - F.coalesce(F.sum("weight").over(before), none)
    # In this order all that come before one that is full are full.
    rows = rows.withColumn("_full", F.col("_most") * left_weights <= left * F.col("weight"))
    used = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_most"))).over(everything), none)
    used_weights = F.coalesce(F.sum(F.when(F.col("_full"), F.col("weight"))).over(everything), none)
    shared = F.try_divide((F.col("_total") - used) * F.col("weight"), F.col("_weights") - used_weights)
    return rows.select("source", "source_size", "weight", F.when(F.col("_full"), F.col("_most")).otherwise(shared).alias("target"))


def _size_class(size: str) -> str:
    """SQL of a class that grows with the size, 64 for each doubling."""
    shift = f"greatest(length(bin({size})) - 7, 0)"
    return f"64L * {shift} + shiftright({size}, {shift})"


def mix(
    df: DataFrame, size: Column, *, source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, cap: float = CAP, seed: str = "mix",
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target`` and ``copies``, how often the mix takes the row.

    ``key`` orders rows of like size by its digest. Columns of the new names are replaced, unless they are the source or the key.
    """
    new = [c for c in ("size", "source_size", "target", "copies") if c not in (source, key)]
    rows = df.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))).drop(*new)
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    plain = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = rows.withColumns({
        "_source": name,
        "_class": F.expr(_size_class("_size")),
        "_digest": F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")),
        "_row": F.xxhash64(*plain),
    })
    rows = materialize(rows, "sized")
    classes = rows.groupBy("_source", "_class").agg(
        F.first(F.col(source).cast("string")).alias("source"), F.count("*").alias("_rows"), F.sum("_size").alias("_words")
    )
    classes = materialize(classes, "classes")
    sources = classes.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    told = targets(sources.drop("_source"), weights, share, cap).withColumn(
        "_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    )
    each = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    told = told.select("_source", "source_size", "target", each.alias("_each"), _unit(F.concat(F.lit(f"{seed}:"), "_source")).alias("_offset"))
    parts = classes.select("_source", "_class", F.ceil(F.col("_rows") / BIN_ROWS).cast("long").alias("_parts"))
    # The leading 32 bits of the digest, in as many equal ranges as the class has bins.
    leading = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long")
    binned = rows.join(parts, ["_source", "_class"]).withColumn("_bin", F.shiftright(leading * F.col("_parts"), 32)).drop("_parts")
    bins = binned.groupBy("_source", "_class", "_bin").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("_source").orderBy(F.desc("_class"), "_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows").join(told, "_source")
    bins = materialize(bins, "bins")
    within = Window.partitionBy("_source", "_class", "_bin").orderBy("_digest", F.desc("_size"), "_row")
    placed = binned.join(bins, ["_source", "_class", "_bin"]).withColumn("_place", F.row_number().over(within) + F.col("_before"))
    crossed = F.floor(F.col("_place") * F.col("_each") + F.col("_offset")) - F.floor((F.col("_place") - 1) * F.col("_each") + F.col("_offset"))
    copies = F.least(crossed, F.lit(math.ceil(cap))).cast("long")
    kept = [c for c in df.columns if c not in new]
    return placed.select(*[F.col(f"`{c}`") for c in kept], F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"))


def take(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as ``copies`` says, numbered from 1 in ``copy``."""
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.filter("copies > 0").withColumn("copy", F.explode(times)).drop("copies")
