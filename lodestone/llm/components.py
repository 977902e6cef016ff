"""Connected components by alternating large-star and small-star steps.

Every step is a minimum by node (combined before the exchange) and a join of two checkpointed tables,
so that adaptive execution can split the rows of a node with very many links. Nothing is collected but
the count and a checksum of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._bytes import cut_small as cut


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links: u, v (long). Returns node, component (the smallest node it reaches) for every linked node but the smallest of each component.

    Null ends, loops and repeated links are ignored.
    """
    edges = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("x"), F.least("u", "w").alias("w")))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("x"), "w"))
        met = large.join(least, F.col("u") == F.col("x"))
        small = met.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("w").alias("v")))
        edges = cut(small.distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
