"""Exact quantiles (linear interpolation) that hold for very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_group_stats
from .workspace import materialise


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = 64
) -> DataFrame:
    """One row per key with a column per entry of ``probs`` (name -> probability).

    Equal values are counted first (map-side), then only the value bins that hold a
    wanted rank are ordered. Bins are cut at approximate quantiles of the distinct values,
    so a bin holds about one of ``bins`` parts of its group whatever the values are. The
    cuts are written once, because they may differ between evaluations.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    shares = [i / bins for i in range(1, bins)]
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, 10_000).alias("_cuts"), F.sum("_n").alias("_total")
    )
    binned = join_group_stats(counted, materialise(cuts, "cuts"), keys).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    ).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ranks = {}
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        ranks[name] = (F.floor(pos), F.ceil(pos), pos - F.floor(pos))

    def holds(rank, start, n):
        return (rank >= start) & (rank < start + n)

    wanted = F.lit(False)
    for low, high, _ in ranks.values():
        for r in (low, high):
            wanted = wanted | holds(r, F.col("_start"), F.col("_bn"))
    needed = (
        binned.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bn"), F.first("_total").alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .filter(wanted)
        .select(*keys, "_bin", "_start")
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.join(needed, [*keys, "_bin"]).withColumn(
        "_first", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    )
    aggs = []
    for name, (low, high, _) in ranks.items():
        aggs.append(F.max(F.when(holds(low, F.col("_first"), F.col("_n")), F.col("_v"))).alias(f"_{name}_a"))
        aggs.append(F.max(F.when(holds(high, F.col("_first"), F.col("_n")), F.col("_v"))).alias(f"_{name}_b"))
    picked = placed.groupBy(*keys).agg(F.first("_total").alias("_total"), *aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_{n}_a") + (F.col(f"_{n}_b") - F.col(f"_{n}_a")) * frac).alias(n)
            for n, (_, _, frac) in ranks.items()
        ],
    )


def weighted_quantiles(
    df: DataFrame, keys: list[str], value: str, weight: str, probs: dict[str, float], bins: int = 64
) -> DataFrame:
    """One row per key with a column per entry of ``probs``: the least value up to which the cumulated weight
    reaches that share of the sum.

    Weights of equal values are added first (map-side). Values are cumulated inside bins, cut as
    for ``exact_quantiles``, and shifted by what the bins before them hold, so no task orders a
    group. Negative weights make the cumulated weight fall now and then, so every value is
    looked at and the first that reaches the share counts. A share is reached within 1e-12 of the
    sum of absolute weights.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(weight).alias("_w"), F.sum(F.abs(weight)).alias("_a"))
    counted = counted.filter("_a > 0")
    shares = [i / bins for i in range(1, bins)]
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx("_v", shares, 10_000).alias("_cuts"), F.sum("_w").alias("_total"), F.sum("_a").alias("_size"))
    binned = join_group_stats(counted, materialise(cuts, "cuts"), keys).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts", "_a")
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_bw")).select(
        *keys, "_bin", F.coalesce(F.sum("_bw").over(before), F.lit(0.0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = binned.join(starts, [*keys, "_bin"]).withColumn("_upto", F.col("_start") + F.sum("_w").over(inside))
    return reached.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") >= F.col("_total") * F.lit(float(p)) - F.col("_size") * 1e-12, F.col("_v"))).alias(name)
        for name, p in probs.items()])
