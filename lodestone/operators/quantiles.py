"""Quantiles by group: exact ones by selection in passes of range counts, and sketches that merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources import folders

RANGES = 1024


def _sound(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) <> double('infinity')")


def exact(df: DataFrame, value: str, group: str, shares: list[float], passes: int = 200) -> DataFrame:
    """group, share, quantile (interpolated between the two values around it), n.

    Each quantile needs one or two values by rank. A pass divides the range in which such a value lies into
    1024, counts the rows in each with their least and greatest value, and goes on in the one that holds the
    rank; a range of one value is done. Whatever a group's size, it is a few numbers a range and task that
    travel. Null, NaN and infinite values are left out; a group without others has no row.
    """
    rows = _sound(df, value, group)
    whole = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    place = (F.col("n") - 1) * F.col("share")
    asked = whole.select("g", "n", "lo", "hi", share).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    open_ = folders.stored(asked.select("g", "rank", F.col("rank").alias("left"), "lo", "hi").distinct(), "ranks")
    done = None
    for _ in range(passes):
        found = open_.where("lo = hi").select("g", "rank", F.col("lo").alias("x"))
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("lo < hi")
        ranges = open_.select("g", "lo", "hi").distinct()  # ranks of one range are counted together
        if ranges.isEmpty():
            break
        met = rows.join(ranges, [rows.g.eqNullSafe(ranges.g), rows.v >= ranges.lo, rows.v <= ranges.hi]).select(ranges.g, "lo", "hi", "v")
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * RANGES), F.lit(RANGES - 1)).alias("at")
        each = met.groupBy("g", "lo", "hi", at).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy("g", "lo", "hi").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = each.withColumn("before", before)  # 1024 rows a range at most
        o = open_.alias("o")
        e = each.alias("e")
        into = o.join(e, F.col("o.g").eqNullSafe(F.col("e.g")) & (F.col("o.lo") == F.col("e.lo")) & (F.col("o.hi") == F.col("e.hi")) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c")))
        open_ = folders.stored(into.select("o.g", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("a").alias("lo"), F.col("b").alias("hi")), "ranks")
    else:
        raise RuntimeError(f"not told apart in {passes} passes")
    a, b, q = done.alias("a"), done.alias("b"), whole.select("g", "n", share).withColumn("place", place).alias("q")
    met = q.join(a, F.col("q.g").eqNullSafe(F.col("a.g")) & (F.col("a.rank") == F.floor("place"))).join(b, F.col("q.g").eqNullSafe(F.col("b.g")) & (F.col("b.rank") == F.ceil("place")))
    return met.select(F.col("q.g").alias(group), "share", (F.col("a.x") + (F.col("b.x") - F.col("a.x")) * (F.col("place") - F.floor("place"))).alias("quantile"), "n")


def sketches(df: DataFrame, value: str, group: str, k: int = 400) -> DataFrame:
    """group, sketch, n: a KLL sketch of bounded size for each group; sketches of parts can be merged (``kll_merge_agg_double``)."""
    return _sound(df, value, group).groupBy(F.col("g").alias(group)).agg(F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"), F.count("*").alias("n"))


def of_sketches(held: DataFrame, group: str, shares: list[float]) -> DataFrame:
    """group, share, quantile, n: a value of the data whose rank is off by a small share of n (about 1 percent for k = 400)."""
    ranks = F.array(*[F.lit(float(p)) for p in shares])
    found = F.explode(F.arrays_zip(ranks.alias("share"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("quantile"))).alias("x")
    return held.select(group, "n", found).select(group, "x.share", "x.quantile", "n")
