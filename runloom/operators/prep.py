"""From raw per-run rows to one prepared series per run and time index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.joins import join_group_stats
from ..functions.ordinal import with_ordinal
from ..functions.workspace import materialise


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop by name; a name that is not there is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.drop(*names)


def assign_header(df: DataFrame, names: list[str]) -> DataFrame:
    return df.toDF(*names)


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.fill(0.0, subset=columns)


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def token_field(rows: DataFrame, ordinal: int, name: str, skip_first: bool = False) -> DataFrame:
    """One field of each token row by its 1-based ordinal, with a row number per file.

    ``skip_first`` leaves out the very first row of a file, as a reader that takes it
    for a header would.
    """
    kept = rows.filter(~((F.col("block") == 0) & (F.col("row") == 0))) if skip_first else rows
    value = F.get("tokens", F.lit(ordinal - 1)).try_cast("double")
    return drop_nulls(kept.select("file", "block", "row", value.alias(name)), [name])


def with_time_index(df: DataFrame, keys: list[str], step: str, out: str = "t") -> DataFrame:
    """0-based index of a row inside its run, in order of ``step``."""
    return with_ordinal(df, keys, [step], out)


def _means(columns: list[str], count: Column) -> list[Column]:
    return [(F.sum(c) / count).alias(c) for c in columns]


def block_mean(df: DataFrame, keys: list[str], step: str, columns: list[str]) -> DataFrame:
    """Mean over all points of a time step, with a 0-based time index per run."""
    means = df.groupBy(*keys, step).agg(*[F.avg(c).alias(c) for c in columns])
    return with_time_index(means, keys, step)


def positional_block_mean(
    df: DataFrame, keys: list[str], position: str, columns: list[str], size: int, mode: str = "clean"
) -> DataFrame:
    """Sum of ``size`` consecutive rows divided by ``size``, by row position in a run.

    ``clean``: row 0 starts block 0 and only full blocks count.
    ``header_lost``: the first row was taken for a header; the last block may be one row
    short and is still divided by ``size``.
    ``header_lost_skip_block``: as before, and the first block is left out too.
    """
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    shift = {"clean": 0, "header_lost": 1, "header_lost_skip_block": 1 + size}[mode]
    rows = df.filter(F.col(position) >= shift).withColumn(
        "t", F.floor((F.col(position) - shift) / F.lit(float(size))).cast("long")
    )
    left = F.col("_n") - (1 if mode != "clean" else 0)
    blocks = {
        "clean": F.floor(left / F.lit(float(size))),
        "header_lost": F.floor((left + 1) / F.lit(float(size))),
        "header_lost_skip_block": F.floor(left / F.lit(float(size))),
    }[mode]
    out = rows.groupBy(*keys, "t").agg(*_means(columns, F.lit(float(size))))
    return out.join(totals, keys).filter(F.col("t") < blocks).drop("_n")


def step_mean(
    df: DataFrame, keys: list[str], position: str, columns: list[str], sampling_steps: int
) -> DataFrame:
    """Mean of every ``sampling_steps`` rows of a point; an unfinished last block is left out."""
    block = F.floor(F.col(position) / F.lit(float(sampling_steps))).cast("long").alias("t")
    return (
        df.groupBy(*keys, block)
        .agg(F.count(F.lit(1)).alias("_n"), *_means(columns, F.lit(float(sampling_steps))))
        .filter(F.col("_n") == sampling_steps)
        .drop("_n")
    )


def front_pad(
    nano: DataFrame, macro_steps: DataFrame, run: str, point: str, position: str, columns: list[str],
    rows: DataFrame | None = None,
) -> DataFrame:
    """Put one zero row in front of each point that has fewer rows than macro steps.

    ``macro_steps``: (run, steps). A padded point's rows move one place back. ``rows`` may
    name the table to count points from, where that is cheaper to read than ``nano``.
    """
    counts = (nano if rows is None else rows).groupBy(run, point).agg(F.count(F.lit(1)).alias("_n"))
    short = counts.join(macro_steps, run).filter(F.col("_n") < F.col("steps")).select(run, point)
    moved = join_group_stats(nano, short.withColumn("_pad", F.lit(1)), [run, point], "left").select(
        run, point, (F.col(position) + F.coalesce("_pad", F.lit(0))).cast("long").alias(position), *columns
    )
    zero = short.select(
        run, point, F.lit(0).cast("long").alias(position), *[F.lit(0.0).alias(c) for c in columns]
    )
    return moved.unionByName(zero)


def still_short(rows: DataFrame, macro_steps: DataFrame, run: str, point: str) -> DataFrame:
    """Runs with a point that one row of padding does not bring up to the macro steps."""
    counts = rows.groupBy(run, point).agg(F.count(F.lit(1)).alias("_n"))
    return counts.join(macro_steps, run).filter(F.col("_n") + 1 < F.col("steps")).select(run).distinct()


def run_status(status: DataFrame, designed: DataFrame, run: str) -> DataFrame:
    """One row per designed run: a run without any output is ``missing`` with no points and steps."""
    return designed.select(run).distinct().join(status, run, "left").withColumns({
        "points": F.coalesce("points", F.lit(0)), "steps": F.coalesce("steps", F.lit(0)),
        "status": F.coalesce("status", F.lit("missing")),
    })


def mean_across_points(
    df: DataFrame, run: str, t: str, point: str, columns: list[str], short: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Mean over the points of a run per time index, and one status row per run.

    Time indices of a point run from 0 without gaps, so the points are those at index 0.
    A run where a later index lacks a point is reported as ``ragged`` and left out of the
    means, and so is a run named by ``short`` (status ``short``); other runs are kept. The
    sums serve both results and are written once.
    """
    sums = materialise(
        df.groupBy(run, t).agg(F.count(point).alias("_points"), *[F.sum(c).alias(c) for c in columns]), "sums"
    )
    status = (
        sums.groupBy(run)
        .agg(F.max("_points").alias("points"), F.min("_points").alias("_least"), F.count(F.lit(1)).alias("steps"))
        .withColumn("status", F.when(F.col("points") == F.col("_least"), "ok").otherwise("ragged"))
        .drop("_least")
    )
    if short is not None:
        status = status.join(short.withColumn("_short", F.lit(True)), run, "left").withColumn(
            "status", F.when(F.col("_short"), "short").otherwise(F.col("status"))).drop("_short")
    good = status.filter(F.col("status") == "ok").select(run, "points")
    means = (
        sums.join(good, run)
        .select(run, t, *[(F.col(c) / F.col("points")).alias(c) for c in columns])
    )
    return means, status


def join_scales(macro: DataFrame, nano: DataFrame, keys: list[str]) -> DataFrame:
    """Right join on run and time index; a time step without macro values gets 0.0."""
    return fill_zero(macro.join(nano, keys, "right"))


def prepare_outputs(
    macro: DataFrame, nano: DataFrame, sampling_steps: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Raw macro and nano rows of many runs to the 12-column output, plus run status.

    ``macro``: run_id, timestep, qpid, stress_*; ``nano``: run_id, qpid, time_id, stress_*. A
    run with ragged points, or with a point still short after padding, is reported and left out.
    """
    s = schemas.STRESS
    macro_mean = block_mean(macro, ["run_id"], "timestep", s).drop("timestep")
    steps = macro_mean.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"))
    indexed = with_ordinal(nano, ["run_id", "qpid"], ["time_id"], "position")
    padded = front_pad(indexed, steps, "run_id", "qpid", "position", s, nano)
    sampled = step_mean(padded, ["run_id", "qpid"], "position", s, sampling_steps)
    short = still_short(nano, steps, "run_id", "qpid")
    nano_mean, status = mean_across_points(sampled, "run_id", "t", "qpid", s, short)
    wide = join_scales(
        macro_mean.select("run_id", "t", *[F.col(c).alias(f"{c}_macro") for c in s]),
        nano_mean.select("run_id", "t", *[F.col(c).alias(f"{c}_nano") for c in s]),
        ["run_id", "t"],
    )
    return wide, status


def series_to_matrix(df: DataFrame, keys: list[str], column_key: str, value: str, columns: list) -> DataFrame:
    """Long series to one column per entry of ``columns``."""
    return df.groupBy(*keys).pivot(column_key, columns).agg(F.first(value))


def series_to_array(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """One ordered array per key. For short series (a run's time steps) only."""
    pairs = F.sort_array(F.collect_list(F.struct(t, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias(value))
