"""Collation of runs to one long table, and the feature tables made from it.

Long form: (run_id, parameters..., weight, qoi, t, value), one row per run, quantity of
interest and time index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_group_stats
from ..functions.ordinal import with_spread_ordinal
from ..functions.polynomials import Marginal
from ..functions.vectors import frobenius


def collate(outputs: DataFrame, keys: list[str], qois: list[str]) -> DataFrame:
    """Wide per-run outputs to the long table."""
    return outputs.unpivot(keys, qois, "qoi", "value")


def attach_parameters(outputs: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Every result row with the parameters of its run.

    An equi-join without hint: Spark sends the run table to all tasks while it is below
    the broadcast threshold and shuffles both sides (splitting skewed runs) beyond it.
    """
    return outputs.join(runs, key)


def run_vectors(collated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Target vector of each run and QoI, ordered by time index."""
    keys = keys or ["run_id", "qoi"]
    pairs = F.sort_array(F.collect_list(F.struct("t", "value")))
    return collated.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("target"))


def train_test_split(runs: DataFrame, test_frac: float = 0.2, campaign: str | None = None) -> DataFrame:
    """First rows train: ``split`` by the position of the run id in its campaign."""
    if campaign:
        counts = runs.groupBy(campaign).agg(F.count(F.lit(1)).alias("_n"))
        placed = with_spread_ordinal(runs, [campaign], ["run_id"], "position")
        placed = join_group_stats(placed, counts, [campaign])
    else:
        placed = with_spread_ordinal(runs, [], ["run_id"], "position").withColumn("_n", F.lit(runs.count()))
    train = F.col("position") < F.floor(F.col("_n") * F.lit(1.0 - test_frac) + F.lit(1e-9))
    return placed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_n")


def scale_targets(collated: DataFrame) -> DataFrame:
    """Value divided by the Frobenius norm of its QoI matrix (all runs and times)."""
    norms = collated.groupBy("qoi").agg(frobenius(F.col("value")).alias("norm"))
    return join_group_stats(collated, norms, ["qoi"]).withColumn("value", F.col("value") / F.col("norm")).drop("norm")


def feature_norm(runs: DataFrame, names: list[str]) -> float:
    """Frobenius norm of the feature matrix: one number."""
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n) * F.col(n)
    return float(runs.agg(F.sqrt(F.sum(total)).alias("norm")).first()["norm"])


def scale_features(runs: DataFrame, names: list[str]) -> DataFrame:
    norm = feature_norm(runs, names)
    return runs.withColumns({n: F.col(n) / F.lit(norm) for n in names})


def feature_moments(runs: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per feature: two numbers each."""
    row = runs.agg(
        *[F.avg(n).alias(f"{n}_m") for n in names], *[F.stddev_pop(n).alias(f"{n}_s") for n in names]
    ).first()
    return {n: (row[f"{n}_m"], row[f"{n}_s"]) for n in names}


def standardise(runs: DataFrame, names: list[str], moments: dict | None = None) -> DataFrame:
    """Z-scores, with the moments of the table itself or of the training features."""
    moments = moments or feature_moments(runs, names)
    return runs.withColumns({n: (F.col(n) - moments[n][0]) / moments[n][1] for n in names})


def feature_summary(runs: DataFrame, names: list[str]) -> DataFrame:
    """Mean of every feature as (param, mean)."""
    return runs.agg(*[F.avg(n).alias(n) for n in names]).unpivot([], names, "param", "mean")


def matrix_norms(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(frobenius(F.col(value)).alias("norm"))


def relative_error(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Norm of (value - prediction) over norm of value, and the mean squared error."""
    gap = F.col("value") - F.col("prediction")
    return predictions.groupBy(*keys).agg(
        (frobenius(gap) / frobenius(F.col("value"))).alias("rel_error"),
        F.avg(gap * gap).alias("mse"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_over_qois(sensitivity: DataFrame, value: str = "sensitivity") -> DataFrame:
    """Mean of a sensitivity over all QoIs, by parameter name."""
    return sensitivity.groupBy("param").agg(F.avg(value).alias(value))


def rank_parameters(sensitivity: DataFrame, keys: list[str], value: str = "sensitivity") -> DataFrame:
    """Rank 1 is the largest; ties by name. A group holds one row per parameter."""
    keyed = sensitivity if keys else sensitivity.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*(keys or ["_all"])).orderBy(F.desc(value), F.asc("param"))
    out = keyed.withColumn("rank", F.row_number().over(w))
    return out if keys else out.drop("_all")


def min_max_scaled(sensitivity: DataFrame, keys: list[str], value: str = "sensitivity") -> DataFrame:
    """(s - min) / (max - min) over the parameters of a group; 0 where that is undefined."""
    keyed = sensitivity if keys else sensitivity.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*(keys or ["_all"]))
    span = F.max(value).over(w) - F.min(value).over(w)
    scaled = F.coalesce(F.nanvl(F.try_divide(F.col(value) - F.min(value).over(w), span), F.lit(0.0)), F.lit(0.0))
    out = keyed.withColumn("_scaled", scaled).drop(value).withColumnRenamed("_scaled", value)
    return out if keys else out.drop("_all")


def total_sensitivity(sensitivity: DataFrame, scaled: bool = False) -> DataFrame:
    """Mean over QoIs (optionally min-max scaled) with the ranking of the parameters."""
    mean = mean_over_qois(sensitivity)
    return rank_parameters(min_max_scaled(mean, []) if scaled else mean, [])
