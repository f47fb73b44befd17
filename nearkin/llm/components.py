"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.session import materialize


def connected(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``links(a, b)``: the smallest id it reaches.

    Each round hangs all larger neighbours of an id on its smallest one, then the id and its smaller neighbours
    likewise, until only stars are left. Minima are combined before their shuffle; a hub of many links only
    meets one minimum, a join that Spark splits. Each round is written, so lost executors undo one round at most.
    Links to oneself and null ends are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.expr("a <> b").alias("real"))
    edges = materialize(edges.filter("real").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = (state["n"], state["h"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.expr("v = m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.distinct(), "edges")
