"""What each filter of a chain removes under every order of the filters."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import materialise
from .columns import map_columns

# Orders grow with the factorial of the number of filters; so many make 5,040 orders.
MOST_FILTERS = 7
# Bytes of a text that are split into words at once.
PIECE = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
FACTS = "n_words long, n_distinct long, n_upper long, n_chars long, n_symbols long, digest binary"


def _words(data: bytes) -> tuple[int, int]:
    """Number of words and of distinct words; a long text is split piece by piece, at blanks."""
    if len(data) <= PIECE:
        words = data.split()
        return len(words), len(set(words))
    total, seen, at = 0, set(), 0
    while at < len(data):
        cut = BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = data[at:end].split()
        total += len(words)
        seen.update(words)
        at = end
    return total, len(seen)


def text_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text and with counts over each whole text and its SHA-256 digest.

    Words are runs of other characters than ASCII blanks, in their own case. A null text is
    an empty one. Memory of a task follows the distinct words of one text. Other columns may
    have any names; those named like a fact are replaced.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                body = value.as_py() or ""
                data = body.encode()
                rows.append((
                    *_words(data), len(data) - len(data.translate(None, UPPER)), len(body),
                    len(data) - len(data.translate(None, SYMBOLS)), hashlib.sha256(data).digest()))
            *counts, digests = list(zip(*rows)) or [()] * 6
            yield batch, [*[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.binary())]

    return map_columns(docs, text, FACTS, measure, keep=False)


def failure_counts(
    docs: DataFrame, labels: DataFrame, filters: Sequence[tuple[str, str | None]], key: str = "doc_id",
    text: str = "text", part: str = "source",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of filters that they fail.

    ``filters`` has a letter and an SQL condition over ``text_facts`` each; bit i of the mask says
    that filter i fails. A condition of None fails where a smaller key has the same text,
    anywhere in the table. ``good`` counts those with a label quality = 1, ``toxic`` those
    with toxic = 1; of several labels of a key one is enough. A null part is the empty one. A
    null key has no label and is neither smaller nor larger than another. Repeated rows each
    count and fail alike.

    Digests are reduced to their least key on the map side and met by (digest, key), so a
    text that a third of all rows share is spread over its keys.
    """
    facts = text_facts(docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")))
    mask = F.lit(0)
    for i, (_, fails) in enumerate(filters):
        if fails is not None:
            mask = mask + F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0))
    again = sum(1 << i for i, (_, fails) in enumerate(filters) if fails is None)
    rows = materialise(facts.select("key", "part", "digest", mask.cast("int").alias("mask")), "audit")
    rows = rows.groupBy("key", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.filter("key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without a key meet nothing, so they are not dealt out by it.
    known = rows.filter("key IS NOT NULL").join(first, ["digest", "key"], "left").join(marks, "key", "left").select(
        "part", (F.col("mask") + F.when(F.col("first"), F.lit(0)).otherwise(F.lit(again))).alias("mask"), "n",
        (F.coalesce("good", F.lit(0)) * F.col("n")).alias("good"), (F.coalesce("toxic", F.lit(0)) * F.col("n")).alias("toxic"))
    nameless = rows.filter("key IS NULL").select(
        "part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def removal_intervals(count: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first, end): the order ranks under which a document with ``mask`` goes at ``step``.

    Orders are ranked lexicographically by their Lehmer code, so the orders that begin with
    one prefix are one interval of ranks. A document goes at the step whose filter is the
    first that it fails, which is one interval per prefix that ends there.
    """
    out = []

    def descend(left: tuple[int, ...], first: int, step: int) -> None:
        width = math.factorial(len(left) - 1)
        for place, chosen in enumerate(left):
            rest, at = left[:place] + left[place + 1:], first + place * width
            for bits in range(1 << len(rest)):
                others = sum(1 << f for i, f in enumerate(rest) if bits >> i & 1)
                out.append((1 << chosen | others, step, at, at + width))
            if rest:
                descend(rest, at, step + 1)

    descend(tuple(range(count)), 0, 1)
    return out


def audit_orders(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_counts``.

    Each mask adds its counts at the first rank of its intervals and takes them away at the
    end; running sums over the ranks of a (part, step) give what the step removes. Columns:
    part, filter_order, step, kept (after the step), removed, redundant (fail the step's
    filter but went before), unique_fails (fail this filter only), good_lost, toxic_lost and
    shapley (what the step's filter removes in all orders together). Parts without failures
    have zeros; an empty table gives no rows.
    """
    size = len(letters)
    if not 1 <= size <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited")
    spark, orders = counts.sparkSession, math.factorial(size)
    sums = ["n", "good", "toxic"]
    # Fixed by the number of filters: 840 rows for five of them.
    intervals = spark.createDataFrame(removal_intervals(size), "mask int, step int, first int, end int")
    ends = F.explode(F.array(
        F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("rank"), F.lit(-1).alias("sign"))))
    steps = counts.join(F.broadcast(intervals), "mask").select("part", "step", ends.alias("e"), *sums).select(
        "part", "step", "e.rank", *[(F.col(c) * F.col("e.sign")).alias(c) for c in sums])
    grid = counts.select("part").distinct().select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"),
        *[F.lit(0).cast("long").alias(c) for c in sums])
    differences = steps.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums])
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = differences.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in sums]).filter(
        F.col("rank") < orders)
    names = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    named = removed.withColumn("filter_order", F.get(names, F.col("rank"))).withColumn(
        "filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    per_filter = [F.struct(
        F.lit(x).alias("filter"),
        F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(F.lit(0))).alias("fails"),
        F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(F.lit(0))).alias("unique_fails")) for i, x in enumerate(letters)]
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), F.array(*per_filter).alias("filters")).select(
        "part", "total", F.inline("filters"))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    everywhere = Window.partitionBy("part", "filter")
    return named.join(totals, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("total") - F.sum("n").over(so_far)).alias("kept"), F.col("n").alias("removed"),
        (F.col("fails") - F.col("n")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"), F.sum("n").over(everywhere).alias("shapley"))
