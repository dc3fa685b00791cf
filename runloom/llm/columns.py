"""Tables whose columns may have any names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...: dots, repeats and names that operators use inside do no harm."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def map_columns(
    docs: DataFrame, read: str, made: str, function: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list]]],
    keep: bool = True,
) -> DataFrame:
    """``docs`` with the columns ``made`` (as DDL) that ``function`` makes of its batches.

    The function gets batches whose column ``read`` is named ``text`` and gives parts of them
    with the made arrays. Columns travel under names by place, so dots, repeats and clashes in
    names do no harm; columns named like made ones are replaced. ``keep`` keeps the read column.
    """
    new = StructType.fromDDL(made)
    at = docs.columns.index(read)
    kept = [i for i, c in enumerate(docs.columns) if c not in new.names and (keep or i != at)]
    plain = by_place(docs)
    plain = plain.select(*[f"c{i}" for i in kept], plain[f"c{at}"].alias("text"))
    schema = StructType([*plain.schema.fields[:-1], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, arrays in function(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in kept], *new.names)


def repeat_rows(rows: DataFrame, times: str, block: int = 1024) -> DataFrame:
    """Each row as often as its column ``times`` says, without that column.

    Rows that are repeated more often than ``block`` are dealt out in blocks first, so that
    no array is longer than about the square root of a count and no task repeats a row alone.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c != times]
    few = rows.filter(F.col(times) <= block)
    once = F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(block).cast("long"))
    many = rows.filter(F.col(times) > block).withColumn("_block", F.explode(once)).repartition("_block").withColumn(
        times, F.least(F.lit(block).cast("long"), F.col(times) - F.col("_block"))).drop("_block")
    return few.unionByName(many).select(*kept, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias("_turn")).drop("_turn")
