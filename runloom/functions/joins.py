"""Join of rows with the statistics of their group, safe for very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 16


def join_group_stats(
    rows: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner", spread: int = SPREAD
) -> DataFrame:
    """Rows with the few rows of ``stats`` that have their keys.

    Rows are salted by a hash of their values and ``stats`` is repeated per salt, so a
    group with a third of all rows is met by ``spread`` tasks where Spark shuffles both
    sides, however the rows lay before. Spark sends ``stats`` to all tasks instead while it is below the broadcast
    threshold. A grouping that follows combines on the map side first, because the join
    is not partitioned by the keys alone.
    """
    values = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map" not in f.dataType.simpleString()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(spread)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
