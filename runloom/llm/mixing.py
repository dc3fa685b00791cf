"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import materialise
from .columns import by_place

# Poisson means above this are drawn as a sum of independent parts.
PART_MEAN = 8.0
# A uniform number has 52 bits; at a mean of 8 the tail beyond 60 is far below 2^-52.
LONGEST = 60
# Source tables up to this size are sent to all tasks.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) drawn from the MD5 of the parts, null read as nothing."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def poisson_parts(mean: Column) -> Column:
    """Number of independent equal parts that a Poisson variate is drawn in; none for mean 0."""
    return F.ceil(mean / PART_MEAN).cast("int")


def poisson_distribution(mean: Column) -> Column:
    """Probabilities of at most 0, 1, ... LONGEST for one part of the mean."""
    each = mean / F.greatest(poisson_parts(mean), F.lit(1))
    start = F.struct(F.exp(-each).alias("term"), F.array(F.exp(-each)).alias("below"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * each / k
        return F.struct(term.alias("term"), F.concat(state["below"], F.array(F.get(state["below"], k - 1) + term)).alias("below"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST)), start, step, lambda s: s["below"])


def poisson_count(parts: Column, distribution: Column, seed: str, key: Column) -> Column:
    """Poisson variate of each key by inverting the distribution at its hash.

    A large mean is split into equal parts, each inverted at a hash of its own; the sum has
    the wanted distribution, and no exponential underflows.
    """
    drawn = F.transform(
        F.filter(F.sequence(F.lit(0), parts), lambda i: i > 0), lambda i: _uniform(F.lit(seed), i.cast("string"), key))
    return F.aggregate(drawn, F.lit(0), lambda total, u: total + F.size(F.filter(distribution, lambda p: p < u)))


def source_rates(docs: DataFrame, exponent: float, epochs: float, source: str = "source", text: str = "text") -> DataFrame:
    """(source, size, target, rate): how often a document of each source shall appear on average.

    Size is the sum of UTF-8 lengths plus one per document. Target weights are proportional
    to ``size ** exponent`` (1 keeps the natural mix, 0 makes sources equal) and the whole
    result has ``epochs`` times the input's size. A null source is a source.
    """
    sizes = materialise(docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size")), "sizes")
    power = F.pow(F.col("size").cast("double"), F.lit(exponent))
    # Two numbers.
    powers, total = sizes.agg(F.sum(power), F.sum("size")).first()
    target = power / F.lit(powers or 1.0)
    return sizes.select(
        "source", "size", target.alias("target"),
        (target * F.lit(float(total or 0)) * F.lit(float(epochs)) / F.col("size")).alias("rate"))


def mix_sources(
    docs: DataFrame, rates: DataFrame, seed: str = "mix", key: str = "doc_id", source: str = "source",
    broadcast_sources: int = BROADCAST_SOURCES, copy: str = "copy", order: str = "order_key",
) -> DataFrame:
    """Every document as often as its Poisson count says, in global hash order, with its copy and order key.

    The count depends on the seed and the key, so equal keys have equal counts and a rerun
    gives the same mix. Rows of a source that ``rates`` does not name are left out, since
    their target is 0; a null source meets the null source. Copies of one document are
    numbered from 0 and lie anywhere: the result is range-partitioned and sorted by a hash
    of seed, copy and key. Other columns pass through whatever their names and types; those
    named like a result column are replaced.
    """
    rates = rates.select(
        F.col("source").alias("_source"), poisson_parts(F.col("rate")).alias("_parts"),
        poisson_distribution(F.col("rate")).alias("_below"))
    if rates.count() <= broadcast_sources:
        rates = F.broadcast(rates)
    kept = [i for i, c in enumerate(docs.columns) if c not in (copy, order)]
    id_, from_ = (F.col(f"c{docs.columns.index(c)}") for c in (key, source))
    text_key = id_.cast("string")
    counted = by_place(docs).select(*[f"c{i}" for i in kept]).join(rates, from_.eqNullSafe(F.col("_source")))
    times = F.array_repeat(F.lit(0), poisson_count(F.col("_parts"), F.col("_below"), seed, text_key))
    copies = counted.select(*[f"c{i}" for i in kept], F.posexplode(times).alias("_copy", "_unused")).drop("_unused")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("_copy").cast("string"), text_key))
    keyed = copies.withColumn("_order", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    ordered = keyed.repartitionByRange("_order").sortWithinPartitions("_order", id_, "_copy")
    return ordered.toDF(*[docs.columns[i] for i in kept], copy, order)
