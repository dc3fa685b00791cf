"""Repeated passages by content-defined chunks: a gear rolling hash cuts, digests find copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.workspace import materialise
from .columns import by_place
from .shingles import _column_bytes, mix, slices

# Chunks of 16 to 256 bytes, 32 on average; the rolling hash looks at 16 bytes.
LEAST, MOST, BITS, WINDOW = 16, 256, 4, 16
# Repeated chunks in a row are reported if they have this many bytes together.
PASSAGE_BYTES = 100
# A digest with more places is cut into so many parts.
CROWD, PARTS = 4096, 256

CHUNKS = "key {key}, text_hash long, start long, length int, high long, low long"


def _gear() -> np.ndarray:
    """One random number per byte."""
    return (mix(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32)


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the gear hash of the last 16 bytes has four zero top bits.

    The hash ``h = (h << 1) + gear[byte]`` is summed for all positions at once by doubling
    the window. Positions inside a UTF-8 character are left out, so chunks are valid text.
    """
    h = _gear()[data]
    span = 1
    while span < WINDOW:
        shifted = np.zeros_like(h)
        shifted[span:] = h[:-span] << np.uint32(span)
        h = h + shifted
        span *= 2
    ends = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends = ends[ends < len(data)]
    return ends[(data[ends] & 0xC0) != 0x80]


def cut_row(data: bytes, candidates: list[int]) -> list[int]:
    """Ends of the chunks of one text: candidates at least LEAST apart, cut at MOST without one."""
    out, start, n = [], 0, len(data)

    def fill(until: int) -> int:
        at = start
        while until - at > MOST:
            at += MOST
            while data[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
        return at

    for c in candidates:
        if c - start >= LEAST:
            start = fill(c)
            if c - start >= LEAST:
                out.append(c)
                start = c
    fill(n)
    if n and (not out or out[-1] != n):
        out.append(n)
    return out


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, start, length, high, low): the chunks of every whole text, in bytes, with their 128-bit digest.

    ``text_hash`` tells texts of one key apart. The chunks of a text join up to the text. Null and empty texts have none.
    """
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", 1 << 20):
                data, rows = _column_bytes(part.column("_text"))
                if not len(data):
                    continue
                candidates = cut_candidates(data)
                first = np.searchsorted(candidates, rows)
                raw = data.tobytes()
                owner, starts, lengths, digests = [], [], [], []
                for i in range(part.num_rows):
                    a, b = int(rows[i]), int(rows[i + 1])
                    own = candidates[first[i]: first[i + 1]] - a
                    own = own[own >= WINDOW].tolist()
                    body, at = raw[a:b], 0
                    for end in cut_row(body, own):
                        starts.append(at)
                        lengths.append(end - at)
                        digests.append(hashlib.blake2b(body[at:end], digest_size=16).digest())
                        at = end
                        owner.append(i)
                halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                rows_of = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key").take(rows_of), part.column("_hash").take(rows_of), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                    names=["key", "text_hash", "start", "length", "high", "low"])

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).filter("_key IS NOT NULL")
    return rows.mapInArrow(work, CHUNKS.format(key=kind))


def _shared_places(spans: DataFrame) -> DataFrame:
    """(key, text_hash, start, end, kept): each place of the digests that have several.

    Input: places with ``deal``, which cuts those of one digest into parts, and with the digest's ``least`` and ``last``
    place where it has more than one part.
    """
    part = Window.partitionBy("high", "low", "deal")
    met = spans.withColumn("_n", F.count(F.lit(1)).over(part)).filter("_n > 1 OR least IS NOT NULL")
    place = F.struct("key", "text_hash", "start")
    upto = part.orderBy("key", "text_hash", "start")
    whole = upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = met.withColumns({
        "least": F.coalesce("least", F.first(place).over(whole)), "last": F.coalesce("last", F.last(place).over(whole)),
        "_before": F.lag(place).over(upto)})
    # Rows with equal key and text have equal places, of which one stays.
    once = known.filter("least <> last").filter(F.col("_before").isNull() | (F.col("_before") != place))
    return once.select("key", "text_hash", "start", "end", (place == F.col("least")).alias("kept"))


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", passage_bytes: int = PASSAGE_BYTES, crowd: int = CROWD,
) -> DataFrame:
    """(key, start, end, n_chunks, kept, text_hash): passages that stand in several places, in bytes.

    A place is (key, hash of the text, start); a chunk counts if its digest has several,
    be it in different documents or in one. The least place is ``kept``; all others are
    copies, also those in the same document. A run of repeated chunks in a row is reported
    if it has ``passage_bytes`` bytes, cut where kept chunks and copies meet. Places move once
    to those of equal digest. Digests with more than ``crowd`` places are found first, by
    one half of them, and their least place before places move, so a chunk that very many
    documents have is split between tasks. Rows with a null key are left out; rows with equal key and
    text are one document.
    """
    chunks = chunk_documents(docs, key, text)
    crowded = materialise(chunks.groupBy("high").count().filter(F.col("count") > crowd).select("high"), "crowded")
    spans, place = chunks.withColumn("end", F.col("start") + F.col("length")).drop("length"), F.struct("key", "text_hash", "start")
    if crowded.isEmpty():
        none = F.lit(None).cast(spans.select(place.alias("p")).schema["p"].dataType)
        dealt = spans.withColumns({"deal": F.lit(0), "least": none, "last": none})
    else:
        # Least and greatest place differ if there are two; both are found on the map side first.
        ends = materialise(spans.join(crowded, "high", "left_semi").groupBy("high", "low").agg(
            F.min(place).alias("least"), F.max(place).alias("last")), "ends")
        deal = F.when(F.col("least").isNull(), 0).otherwise(F.pmod(F.xxhash64("key", "text_hash", "start"), F.lit(PARTS))).cast("int")
        dealt = spans.join(ends, ["high", "low"], "left").withColumn("deal", deal)
    places = _shared_places(dealt)
    w = Window.partitionBy("key", "text_hash").orderBy("start", "end")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.coalesce(F.lag("end").over(w) == F.col("start"), F.lit(False))
    alike = goes_on & (F.lag("kept").over(w) == F.col("kept"))
    runs = places.withColumns({"_new_run": (~goes_on).cast("int"), "_new": (~alike).cast("int")}).withColumns({
        "_run": F.sum("_new_run").over(upto), "_part": F.sum("_new").over(upto)})
    parts = runs.groupBy("key", "text_hash", "_run", "_part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_chunks"),
        F.first("kept").alias("kept"))
    # The whole run counts, although its chunks may have owners in several documents.
    whole = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("key", "text_hash", "_run"))
    return parts.withColumn("_whole", whole).filter(F.col("_whole") >= passage_bytes).select(
        F.col("key").alias(key), "start", "end", "n_chunks", "kept", "text_hash")


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the copies among ``passages``; the kept place of each passage stays.

    All columns and rows stay, whatever the names and types of other columns; a document
    that is nothing but copies gets an empty text.
    """
    plain = by_place(docs)
    names, (at, place) = plain.columns, (docs.columns.index(c) for c in (key, text))
    id_, whole = F.col(names[at]), F.col(names[place])
    copies = passages.filter(~F.col("kept")).groupBy(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts"))
    met = plain.join(copies, (id_ == F.col("_key")) & (F.xxhash64(whole) == F.col("_hash")), "left")
    body = whole.cast("binary")
    n = F.size("_cuts")
    # What lies between two cuts, before the first and after the last.
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        body, (F.when(i == 0, F.lit(0)).otherwise(F.get("_cuts", i - 1)["end"]) + 1).cast("int"),
        F.greatest(F.lit(0), F.when(i == n, F.octet_length(body)).otherwise(F.get("_cuts", i)["start"])
                   - F.when(i == 0, F.lit(0)).otherwise(F.get("_cuts", i - 1)["end"])).cast("int")))
    joined = F.aggregate(kept, F.lit("").cast("binary"), lambda a, x: F.concat(a, x)).cast("string")
    left = F.when(n > 0, joined).otherwise(whole)
    return met.select(*[left.alias(c) if i == place else c for i, c in enumerate(names)]).toDF(*docs.columns)
