"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Records that one task numbers; the number of buckets follows the row count.
BUCKET_ROWS = 200_000


def rendezvous_shard(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """Shard of each key: the one with the largest ``ln(u) / weight``, u drawn from (shard, key).

    A score depends on its shard and the key alone, so a new shard takes rows only into
    itself, a removed one gives up only its own rows, and a changed weight moves rows only
    to or from that shard. Shard s gets a share of ``weight / sum of weights`` of the keys.
    A null key is a key like any other. Equal scores go to the smaller shard.
    """
    if not shards or min(w for _, w in shards) <= 0:
        raise ValueError("give at least one shard, each with a positive weight")
    table = F.array(*[F.struct(F.lit(int(s)).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in shards])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(s["shard"].cast("long"), key), 11).cast("double") + 0.5) / F.lit(2.0**53)
        return F.struct((F.ln(u) / s["weight"]).alias("score"), (-s["shard"]).alias("negated"))

    return -F.array_max(F.transform(table, score))["negated"]


def shard_slots(rows: DataFrame, shard: str, columns: Sequence[str], out: str = "slot") -> DataFrame:
    """Gapless positions from 0 inside each shard, for the distinct rows over ``columns`` and their repeats.

    Rows are counted per shard and hash bucket, the buckets' running sums say where each
    bucket starts, and rows are numbered inside a bucket only, so no task holds a shard.
    Equal rows are counted before they are numbered and share one range of positions.
    The result has the shard, ``columns`` and the position.
    """
    distinct = rows.groupBy(shard, *columns).agg(F.count(F.lit(1)).alias("_n"))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    distinct = distinct.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    starts = distinct.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_rows")).select(
        shard, "_bucket",
        (F.sum("_rows").over(Window.partitionBy(shard).orderBy("_bucket")) - F.col("_rows")).alias("_start"),
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(*columns)
    ends = F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = distinct.withColumn("_end", ends).join(starts, [shard, "_bucket"])
    first = F.col("_start") + F.col("_end") - F.col("_n")
    return numbered.select(
        shard, *columns, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(out)
    )


def shard_records(
    docs: DataFrame, shards: Sequence[tuple[int, float]], key: str = "doc_id", text: str = "text",
    grown: Sequence[tuple[int, float]] | None = None,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every record.

    ``size`` is the UTF-8 length plus 1; a null text has size 1 and the checksum of no
    bytes. Repeated records are kept, each with its own slot in the same shard. An empty
    table gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous_shard(F.col(key).cast("string"), shards).alias("shard"),
        (rendezvous_shard(F.col(key).cast("string"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return shard_slots(rows, "shard", [key, "size", "text_crc32", "grown_shard"])
