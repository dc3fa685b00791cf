"""Containment of short test items in long documents. DataFrame functions only.

A classical MinHash signature of a whole document hardly ever meets that of an item a
hundred times smaller. So items are partitioned by size and each keeps its smallest hashes:
as many as may be missing at the threshold, plus one. A document that holds enough of
the item holds at least one of these, so the search loses nothing. An item with fewer
than five words is one run of its own length, which is looked up among a document's runs
of that length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.workspace import materialise

WORDS = 5
CONTAINED = (4, 5)
# Index rows (one number each) and candidate keys up to this count are sent to all tasks.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _run_hashes(words: Column, lengths: list[int]) -> Column:
    """(length, hash) of all runs of as many words as ``lengths`` says."""
    def of_length(hashes: Column, size: int) -> Column:
        n = F.size(hashes)
        return F.when(n >= size, F.transform(
            F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
            lambda i: F.struct(F.lit(size).alias("length"), F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]).alias("hash")),
        )).otherwise(F.array().cast("array<struct<length:int,hash:bigint>>"))

    # An array of one, so that the words are hashed once and not once per run.
    return F.flatten(F.flatten(F.transform(
        F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.array(*[of_length(h, n) for n in lengths]))))


def _runs(words: Column, lengths: list[int]) -> Column:
    """The distinct runs themselves, as texts."""
    def of_length(w: Column, size: int) -> Column:
        n = F.size(w)
        return F.when(n >= size, F.transform(
            F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "),
        )).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.flatten(F.transform(
        F.array(words), lambda w: F.array(*[of_length(w, n) for n in lengths])))))


def _own_runs(make: Callable[[Column, list[int]], Column], words: Column, size: int) -> Column:
    """Runs of ``size`` words of an item, or the one run that a shorter item is."""
    shorter = F.when(F.size(words) >= size, make(words, [size]))
    for n in range(1, size):
        shorter = shorter.when(F.size(words) == n, make(words, [n]))
    return shorter


def index_items(items: DataFrame, item: str, text: str, size: int = WORDS, contained: tuple[int, int] = CONTAINED) -> DataFrame:
    """(item, size, hash, length, band): the smallest hashes of each item, as many as its size asks for.

    An item of n distinct shingles may miss ``n - ceil(n * contained)``; it keeps that many
    smallest hashes and one more. ``length`` is the number of words of a shingle. ``band`` is
    the size partition: the power of two below n, or ``length - size`` for items below ``size`` words.
    """
    words = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), _words(F.col(text)).alias("words"))
    hashes = words.select("item", F.explode(_own_runs(_run_hashes, F.col("words"), size)).alias("run")).select(
        "item", "run.*").distinct()
    top, below = contained
    packed = hashes.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("hash", "length"))).alias("all"))
    n = F.size("all")
    may_miss = n - F.ceil(n * top / F.lit(below)).cast("int")
    kept = packed.select("item", n.alias("size"), F.explode(F.slice("all", 1, may_miss + 1)).alias("run"))
    return kept.select("item", "size", "run.*").withColumn(
        "band", F.when(F.col("length") < size, F.col("length") - size).otherwise(F.floor(F.log2("size")).cast("int")))


def contaminated(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", size: int = WORDS, contained: tuple[int, int] = CONTAINED,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc, text_hash, item, n_shared, n_item): documents that hold an item's shingles to the given share.

    A shingle is a run of five words in lower case. An item with fewer words is one run of
    its own length, found wherever a document has that run; an item without words is not
    searched. Rows are known by id and text hash: repeated rows count once, equal ids with
    other texts separately; rows with equal item ids are one item with the shingles of all.
    Null and empty texts hold nothing, null item ids are not searched. Candidates come from the index, one size band with its own
    reach and least document size at a time; the result from counting the shingles themselves.
    """
    top, below = contained
    index = materialise(index_items(items, item, item_text, size, contained), "minhash")
    # At most one row per power of two and per length below ``size``.
    bands = index.groupBy("band").agg(
        F.min("length").alias("length"), F.max("hash").alias("reach"), F.min("size").alias("least"),
        F.count(F.lit(1)).alias("rows")).collect()
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    lookup = small(index.select("hash", "length", "item", "size"), sum(r["rows"] for r in bands))
    lengths = sorted({size, *(r["length"] for r in bands)})
    keyed = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("body"))
    # A document with fewer shingles than the share of the item asks for cannot hold it.
    n_runs = sum(F.greatest(F.size("words") - (n - 1), F.lit(0)) for n in lengths)

    def wanted(run: Column) -> Column:
        """Whether a band that the document is long enough for has hashes up to this one."""
        fits = F.lit(False)
        for r in bands:
            fits |= (run["length"] == r["length"]) & (run["hash"] <= r["reach"]) & (F.col("n_runs") * below >= r["least"] * top)
        return fits

    sketched = keyed.select("doc", "text_hash", _words(F.col("body")).alias("words")).withColumn("n_runs", n_runs).select(
        "doc", "text_hash", "n_runs", F.explode(F.filter(_run_hashes(F.col("words"), lengths), wanted)).alias("run"),
    ).select("doc", "text_hash", "n_runs", "run.*")
    fetched = sketched.join(lookup, ["hash", "length"])
    fits = F.col("n_runs") * below >= F.col("size") * top
    pairs = materialise(
        fetched.filter(fits).select("doc", "text_hash", "item").distinct(), "candidates")
    keys = pairs.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    searched = keyed.join(
        small(keys, pairs.count()), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    held = searched.select(
        "doc", "text_hash", F.explode(_runs(_words(F.col("body")), lengths)).alias("shingle")).distinct()
    parts = items.filter(F.col(item).isNotNull()).select(
        F.col(item).alias("item"), _words(F.col(item_text)).alias("words")).select(
        "item", F.explode(_own_runs(_runs, F.col("words"), size)).alias("shingle")).distinct()
    sizes = parts.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    shared = held.join(parts, "shingle").groupBy("doc", "text_hash", "item").agg(F.count(F.lit(1)).alias("n_shared"))
    named = pairs.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("item").alias("_item"))
    return (
        shared.join(named, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
                    & (F.col("item") == F.col("_item")), "left_semi")
        .join(sizes, "item").filter(F.col("n_shared") * below >= F.col("n_item") * top)
        .select(F.col("doc").alias(doc), "text_hash", F.col("item").alias(item), "n_shared", "n_item")
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item; all columns, whatever their names, and repeated rows are kept."""
    found = materialise(contaminated(docs, items, doc, text, **options), "contaminated")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_, body = (F.col(f"c{docs.columns.index(c)}") for c in (doc, text))
    keys = found.select(F.col(doc).alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    keys = F.broadcast(keys) if keys.count() <= options.get("broadcast_rows", BROADCAST_ROWS) else keys
    return plain.join(
        keys, id_.eqNullSafe(F.col("_doc")) & (F.xxhash64(body) == F.col("_hash")), "left_anti").toDF(*docs.columns)
