"""Natural cubic spline resampling as a weighted sum of nearby knots.

On equally spaced knots a natural spline through values that vanish at both ends is the
cardinal spline of the data reflected (with changed sign) about the ends.  The cardinal
spline falls by 2 + sqrt(3) per knot, so beyond REACH knots a weight is below the
rounding of a double.  Each point therefore needs a bounded number of knots, however
long the history is. Their weights depend on the length of a history alone, so histories
of one length share them, and the whole job is one join and one sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialise

# Fixed values of the cardinal cubic spline.
DECAY = math.sqrt(3.0) - 2.0
CURVATURE = -6.0 * math.sqrt(3.0)
CURVATURE_AT_KNOT = 6.0 - 6.0 * math.sqrt(3.0)
REACH = 32
# Steps of a history that are read by one task.
PIECE = 4096


def _curvature(k: Column) -> Column:
    """Second derivative of the cardinal spline at integer distance k >= 0."""
    sign = F.when(k % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return F.when(k == 0, F.lit(CURVATURE_AT_KNOT)).otherwise(
        F.lit(CURVATURE) * sign * F.pow(F.lit(-DECAY), k.cast("double"))
    )


def cardinal(x: Column) -> Column:
    """Value at distance x of the spline that is 1 at knot 0 and 0 at all others."""
    d = F.abs(x)
    k = F.floor(d)
    t = d - k
    a = F.lit(1.0) - t
    here = F.when(k == 0, a).otherwise(F.lit(0.0))
    return here + ((a * a * a - a) * _curvature(k) + (t * t * t - t) * _curvature(k + 1)) / 6.0


def resample_histories(
    df: DataFrame, keys: list[str], step: str, values: list[str], num_points: int, min_steps: int = 2
) -> DataFrame:
    """``num_points`` equally spaced spline values per history, both ends included.

    Steps of a history must be the integers 0..n-1; a history with gaps raises.
    Histories shorter than ``min_steps`` are left out, as the rule of the operator.
    """
    if num_points < 2:
        raise ValueError("num_points must be at least 2")
    step_col = F.col(step).cast("long")
    bounds = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(step_col).alias("_s0"),
        F.max(step_col).alias("_s1"),
        F.min_by(F.struct(*values), step_col).alias("_y0"),
        F.max_by(F.struct(*values), step_col).alias("_y1"),
    ).filter(F.col("_n") >= F.lit(max(2, min_steps)))
    last = F.col("_n") - 1
    checked = F.when(
        (F.col("_s0") == 0) & (F.col("_s1") == last), last
    ).otherwise(F.raise_error(F.lit("history steps must be 0..n-1 without gaps")).cast("long"))
    bounds = bounds.withColumn("_last", checked).drop("_n", "_s0", "_s1")
    # Knots of the reflected line within reach, folded back to real steps: the same for all histories of a length.
    place = F.col("point") * F.col("_last") / F.lit(float(num_points - 1))
    centre = F.floor("_pos")
    period = 2 * F.col("_last")
    folded = F.pmod(F.col("_image"), period)
    knots = (
        bounds.select("_last").distinct().repartition("_last")
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(num_points - 1))))
        .withColumn("_pos", place)
        .withColumn("_image", F.explode(F.sequence(centre - REACH, centre + REACH + 1)))
        .withColumn("_w", cardinal(F.col("_pos") - F.col("_image")))
        .withColumn("_f", folded)
        .withColumn("_sign", F.when(F.col("_f") <= F.col("_last"), F.lit(1.0)).otherwise(F.lit(-1.0)))
        .withColumn("_step", F.when(F.col("_f") <= F.col("_last"), F.col("_f")).otherwise(period - F.col("_f")))
        .groupBy("_last", "point", "_step").agg(F.sum(F.col("_w") * F.col("_sign")).alias("_w"))
        .groupBy("_last", "_step").agg(F.collect_list(F.struct("point", "_w")).alias("_at"))
    )
    # Written because its size is known then: few lengths are sent to all tasks.
    knots = materialise(knots, "knots")
    # A piece of a history meets its length and ends in one task, a long history in several.
    piece = F.floor(F.col("_step") / F.lit(float(PIECE)))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / F.lit(float(PIECE))))
    rows = df.select(*keys, step_col.alias("_step"), *values).withColumn("_piece", piece)
    met = rows.join(bounds.withColumn("_piece", F.explode(pieces)), [*keys, "_piece"])
    joined = (
        met.join(knots, ["_last", "_step"]).select("*", F.inline("_at")).withColumn("_pos", place)
    )

    def line(v: str, at: Column) -> Column:
        y0, y1 = F.col(f"_y0.{v}"), F.col(f"_y1.{v}")
        return y0 + (y1 - y0) * at / F.col("_last")

    summed = joined.groupBy(*keys, "point").agg(
        *[
            (F.sum(F.col("_w") * (F.col(v) - line(v, F.col("_step")))) + F.first(line(v, F.col("_pos")))).alias(v)
            for v in values
        ]
    )
    return summed
