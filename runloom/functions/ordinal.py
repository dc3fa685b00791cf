"""Row positions inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import materialise


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """0-based position of each row inside its key group, in order of ``order``.

    One lazy window for every type and size. A group is sorted by one task, which spills;
    for groups that may hold a large part of the table use ``with_spread_ordinal``.
    """
    inside = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, (F.row_number().over(inside) - 1).cast("long"))


def with_spread_ordinal(
    df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal", size: str | None = None
) -> DataFrame:
    """The same positions without a group in one task; writes one table.

    Rows are range-partitioned by keys, order and, among equals, a hash of the row, so
    any group and any repeated value is spread. They are numbered inside a partition and
    shifted by what earlier partitions hold of their group. The table is written once,
    because ranges differ from one evaluation to the next. The shifts of groups that lie in several
    partitions are written too: they are few, at most two groups a partition. ``size`` names a column
    for the number of rows of the group.
    """
    values = [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]
    # Rows that are equal in keys and order are alike where there is no other column.
    tied = df if set(df.columns) <= {*keys, *order} else df.withColumn("_tie", F.xxhash64(*[F.col(f"`{v}`") for v in values]))
    ties = [F.col("_tie")] if "_tie" in tied.columns else []
    dealt = tied.repartitionByRange(*[F.col(c) for c in [*keys, *order]], *ties)
    stored = materialise(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = stored.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(group).alias("_total"), "_n",
    ).filter(F.col("_total") > F.col("_n")).drop("_n")
    shifts = materialise(shifts, "shifts")
    inside = Window.partitionBy(*keys, "_part")
    placed = stored.withColumn("_place", F.row_number().over(inside.orderBy(*order, *ties)) - 1)
    if size is not None:
        placed = placed.withColumn(size, F.count(F.lit(1)).over(inside))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = placed.join(shifts, (F.col("_part") == F.col("_p")) & same, "left")
    met = met.withColumn(out, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("long"))
    if size is None:
        return met.select(*df.columns, out)
    return met.withColumn(size, F.coalesce("_total", size)).select(*df.columns, out, size)
