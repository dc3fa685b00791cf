"""Block averages, running means and elastic tensors from tables of stress samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import join_group_stats
from ..schemas import PRESSURES

# Voigt order of the components and the unit factor (real units to GPa).
VOIGT = {"pxx": 1, "pyy": 2, "pzz": 3, "pyz": 4, "pxz": 5, "pxy": 6}
STRAIN_OF_DIRECTION = {1: "eeps_00", 2: "eeps_11", 3: "eeps_22", 4: "eeps_12", 5: "eeps_02", 6: "eeps_01"}
LENGTH_OF_DIRECTION = {1: "lx0", 2: "ly0", 3: "lz0", 4: "lz0", 5: "lz0", 6: "ly0"}
CFAC = 1.01325e-4


def averaging_width(total: Column) -> Column:
    """n / 1000 samples for long series (n > 10000), n / 10 otherwise; at least one."""
    wide = F.floor(total / F.lit(1000.0))
    narrow = F.floor(total / F.lit(10.0))
    return F.greatest(F.lit(1), F.when(total > 10000, wide).otherwise(narrow)).cast("long")


def _block_means(
    df: DataFrame, keys: list[str], position: str, columns: list[str], width: Column | None, rows: DataFrame | None,
    size: str | None,
) -> DataFrame:
    """Mean of each full block of samples: keys, block and a column ``<name>_block`` each."""
    if size is None:
        sizes = (df if rows is None else rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        sized = join_group_stats(df, sizes, keys)
    else:
        # A series without a full key is no series, as in the join.
        sized = df.na.drop(subset=keys).withColumn("_n", F.col(size))
    return (
        sized.withColumn("_nav", averaging_width(F.col("_n")) if width is None else width)
        .groupBy(*keys, F.floor(F.col(position) / F.col("_nav").cast("double")).cast("long").alias("block"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.first("_nav").alias("_nav"), *[F.avg(c).alias(f"{c}_block") for c in columns])
        .filter(F.col("_rows") == F.col("_nav"))
        .select(*keys, "block", *[f"{c}_block" for c in columns])
    )


def running_block_means(
    df: DataFrame, keys: list[str], position: str, columns: list[str], width: Column | None = None,
    rows: DataFrame | None = None, size: str | None = None,
) -> DataFrame:
    """Mean of each full block of samples, then the mean of all blocks so far.

    ``position`` is the 0-based sample number of a series. The blocks of a series are at
    most about a thousand, so the ordered part is small however long the series is.
    ``width`` may use ``_n``, the number of samples of the series. ``size`` names a column of ``df`` that
    holds that number; else ``rows`` may name the table to count samples from, where that is cheaper to read.
    """
    blocks = _block_means(df, keys, position, columns, width, rows, size)
    so_far = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.select(
        *keys, "block", *[f"{c}_block" for c in columns],
        *[F.avg(f"{c}_block").over(so_far).alias(f"{c}_running") for c in columns],
    )


def _mean_of_blocks(blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The running mean at the last block of a series."""
    return blocks.groupBy(*keys).agg(*[F.avg(f"{c}_block").alias(c) for c in columns])


def average_lengths(
    df: DataFrame, keys: list[str], position: str, columns: list[str], rows: DataFrame | None = None,
    size: str | None = None,
) -> DataFrame:
    """Cell lengths averaged in blocks of half the run, then over the blocks."""
    half = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(2.0))).cast("long")
    return _mean_of_blocks(_block_means(df, keys, position, columns, half, rows, size), keys, columns)


def averaged_stress(
    samples: DataFrame, position: str = "position", rows: DataFrame | None = None, size: str | None = None
) -> DataFrame:
    """Final running mean per (material, dir, ori); dir 0 is the undeformed state."""
    keys = ["material", "dir", "ori"]
    return _mean_of_blocks(_block_means(samples, keys, position, PRESSURES, None, rows, size), keys, PRESSURES)


def strain_sign(e: Column) -> Column:
    return F.when(e == 0, F.lit(1.0)).otherwise(F.signum(e))


def stiffness_differences(
    stress: DataFrame, states: DataFrame, up: float = 1.0e-2, cfac: float = CFAC
) -> DataFrame:
    """C_ij of every deformation: -(p_i - p_i0) / (delta_j / len0_j) * cfac.

    ``states``: one row per material with lx0, ly0, lz0 and the six eeps_*; delta_j is
    orientation sign * strain sign * up * len0_j. Output (material, ori, i, j, c).
    """
    entries = F.array(*[F.struct(F.lit(v).alias("i"), F.col(p).alias("p")) for p, v in VOIGT.items()])
    long = stress.select("material", "dir", "ori", F.inline(entries))
    base = long.filter(F.col("dir") == 0).select("material", "i", F.col("p").alias("p0"))
    moved = long.filter(F.col("dir") > 0).withColumnRenamed("dir", "j")
    sign = F.lit(None).cast("double")
    length = F.lit(None).cast("double")
    for j in STRAIN_OF_DIRECTION:
        sign = F.when(F.col("j") == j, strain_sign(F.col(STRAIN_OF_DIRECTION[j]))).otherwise(sign)
        length = F.when(F.col("j") == j, F.col(LENGTH_OF_DIRECTION[j])).otherwise(length)
    side = F.when(F.col("ori") == "neg", F.lit(-1.0)).otherwise(F.lit(1.0))
    delta = side * sign * F.lit(up) * length
    return (
        moved.join(base, ["material", "i"])
        .join(states, "material")
        .select(
            "material", "ori", "i", F.col("j").cast("int").alias("j"),
            (-(F.col("p") - F.col("p0")) / (delta / length) * F.lit(cfac)).alias("c"),
        )
    )


def combine_orientations(differences: DataFrame, ori: str | None = None) -> DataFrame:
    """Mean of the negative and positive deformation, or one side only."""
    kept = differences if ori is None else differences.filter(F.col("ori") == ori)
    return kept.groupBy("material", "i", "j").agg(F.avg("c").alias("c"))


def symmetrise(stiffness: DataFrame) -> DataFrame:
    """Mean of C_ij and C_ji; 21 rows (i <= j) per material."""
    return stiffness.groupBy(
        "material", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    ).agg(F.avg("c").alias("c"))


def cubic_moduli(symmetric: DataFrame) -> DataFrame:
    """Cubic averages, bulk modulus, two shear moduli and Poisson ratio per material."""
    i, j = F.col("i"), F.col("j")
    normal = (i == j) & (i <= 3)
    cross = (i < j) & (j <= 3)
    shear = (i == j) & (i > 3)
    pick = lambda cond: F.avg(F.when(cond, F.col("c")))
    averaged = symmetric.groupBy("material").agg(
        pick(normal).alias("c11"), pick(cross).alias("c12"), pick(shear).alias("c44")
    )
    return averaged.select(
        "*",
        ((F.col("c11") + 2.0 * F.col("c12")) / 3.0).alias("bulk"),
        F.col("c44").alias("shear1"),
        ((F.col("c11") - F.col("c12")) / 2.0).alias("shear2"),
        F.try_divide(F.lit(1.0), 1.0 + F.try_divide(F.col("c11"), F.col("c12"))).alias("poisson"),
    )
