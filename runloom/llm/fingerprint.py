"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range.

The fraction is 1/8. A text with few hashes below it keeps a finer one (1/4, 1/2 or all), the
coarsest that holds at most KEEP hashes; which one is the sketch's first number. Two sketches
are compared and merged at the coarser of their fractions, so both hold all hashes below it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import shingle_hashes, slices

WORDS = 5
# One hash of SCALE is kept; of texts with no more than KEEP hashes below a finer fraction, that.
SCALE, KEEP = 8, 128
# Rows of one block when documents meet their neighbours.
BLOCK_ROWS = 5_000
MOST_BLOCKS, CUTS = 65_536, 64
KEY_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def _below(hashes: np.ndarray, scale: int) -> np.ndarray:
    return hashes[hashes <= np.uint64((1 << 64) // scale - 1)]


def _scaled(hashes: np.ndarray, least: int, scale: int) -> np.ndarray:
    """Sketch of sorted, distinct hashes that are all those below the fraction ``least``."""
    if not len(hashes):
        return hashes
    kept = _below(hashes, least)
    while least < scale and len(kept) > KEEP:
        least = min(2 * least, scale)
        kept = _below(kept, least)
    return np.concatenate([np.array([least], np.uint64), kept])


def sketches(texts: pa.Array, size: int = WORDS, scale: int = SCALE) -> list[np.ndarray]:
    """Sketch of each row: its scale, then its distinct hashes below 2^64 / scale, sorted.

    The scale is the least of 1, 2, 4, ... that leaves at most KEEP hashes, and ``scale``
    (a power of two) where none does. Only a text without words has an empty sketch.
    Sketches of parts merge into that of the whole by ``merge``.
    """
    hashes, bounds = shingle_hashes(texts, size)
    return [_scaled(np.unique(hashes[a:b]), 1, scale) for a, b in zip(bounds[:-1], bounds[1:])]


def _common_scale(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of both sketches below the coarser of their fractions."""
    if not len(a) or not len(b):
        return a[1:], b[1:], int(max(*a[:1], *b[:1], 1))
    scale = int(max(a[0], b[0]))
    return _below(a[1:], scale), _below(b[1:], scale), scale


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sketch of the union of two shingle sets, the same as if it were made from their shingles."""
    x, y, least = _common_scale(a, b)
    return _scaled(np.union1d(x, y), least, scale)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, exact where both keep all hashes; two empty sketches are alike."""
    if not len(a) and not len(b):
        return 1.0
    x, y, _ = _common_scale(a, b)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / max(1, len(x) + len(y) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; nothing is contained in anything.

    NaN where ``a`` has shingles, but none of them below the fraction that ``b`` keeps: then the
    sketches cannot tell. A sketch of ``b`` with a smaller ``scale`` can (scale 1 is exact).
    """
    if not len(a):
        return 1.0
    x, y, _ = _common_scale(a, b)
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else float("nan")


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """(key, fingerprint, n_hashes) of every row; a null text has an empty fingerprint, repeated rows repeat."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                made = sketches(part.column("_text"), size, scale)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(map(encode, made)), pa.array([max(0, len(m) - 1) for m in made], pa.int64())],
                    names=[key, "fingerprint", "n_hashes"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).alias("_text")).mapInArrow(work, f"`{key}` {kind}, fingerprint string, n_hashes long")


def with_neighbour_blocks(docs: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with the block of their key; the first row of a block is repeated in the block before it.

    Keys are cut at up to CUTS approximate quantiles and evenly between them; blocks run in
    descending order and the last is followed by the first. Only the cuts and one key for
    each of at most MOST_BLOCKS blocks come to the driver. ``_donor`` marks the repeated
    rows. Null keys come last.
    """
    spark, k = docs.sparkSession, F.col(key).cast("long")
    blocks = min(MOST_BLOCKS, max(1, -(-docs.count() // block_rows)))
    coarse = min(CUTS, blocks)
    marks = sorted({int(x) for x in docs.approxQuantile(key, [i / coarse for i in range(coarse + 1)], 0.1 / coarse)})
    fine = -(-blocks // coarse)
    if marks:
        cuts = F.array(*[F.lit(m).cast("long") for m in marks])
        at = F.greatest(F.lit(0), F.size(F.filter(cuts, lambda m: m <= k)) - 1)
        low, high = F.get(cuts, at), F.coalesce(F.get(cuts, at + 1), F.get(cuts, at) + 1)
        # Doubles: keys may lie further apart than a long can say.
        share = (k.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
        inside = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor(share * fine).cast("int")))
        block = F.coalesce(F.lit((len(marks) + 1) * fine) - at * fine - inside, F.lit(len(marks) * fine + fine + 1))
    else:
        block = F.lit(0)
    placed = docs.withColumn("_block", block.cast("int"))
    heads = [(r["_block"], r["head"]) for r in placed.groupBy("_block").agg(F.max(k).alias("head")).orderBy("_block").collect()]
    gives = spark.createDataFrame(
        [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], "_head long, _gives int")
    met = placed.join(F.broadcast(gives), k.eqNullSafe(F.col("_head")), "left").drop("_head")
    # A lone block is followed by itself: its first row is repeated at its own end.
    own = F.struct(F.col("_block").alias("block"), F.lit(False).alias("donor"))
    given = F.struct(F.col("_gives").alias("block"), F.lit(True).alias("donor"))
    spread = met.withColumn("_at", F.explode(F.when(F.col("_gives").isNull(), F.array(own)).otherwise(F.array(own, given))))
    return spread.drop("_block", "_gives").select("*", F.col("_at.block").alias("_block"), F.col("_at.donor").alias("_donor")).drop("_at")


def edited(text: str, donor: str) -> str:
    """The last third (rounded down) of the code points replaced by the donor's first as many, or all."""
    n = len(text) // 3
    return text[: len(text) - n] + donor[:n]


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's text, and their likeness.

    The next document has the next smaller key (after the smallest: the largest); equal keys
    are ordered by text and null keys come last. Texts move once, into blocks of
    neighbouring keys, and each block is read in order with one row of look-ahead. A null
    text is empty. Repeated rows are neighbours of each other. Keys are of an integer type.
    """
    key_type = KEY_TYPES.get(docs.schema[key].dataType.simpleString())
    if key_type is None:
        raise TypeError(f"the key {key} must be an integer column")
    columns = (
        f"`{key}` {docs.schema[key].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    spread = with_neighbour_blocks(rows, "_key")

    def finished(group: list[tuple]) -> pa.RecordBatch:
        """Rows of one block, each but the last with its successor behind it."""
        texts = [t for _, t in group]
        edits = [edited(t, after) for t, after in zip(texts, texts[1:])]
        own = sketches(pa.array(texts, pa.large_string()), size, scale)
        made = sketches(pa.array(edits, pa.large_string()), size, scale)
        return pa.RecordBatch.from_pydict({
            key: pa.array([k for k, _ in group[:-1]], key_type),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            "fingerprint": [encode(s) for s in own[:-1]],
            "edited_fingerprint": [encode(s) for s in made],
            "near_edited": pa.array([jaccard(a, b) for a, b in zip(own, made)], pa.float64()),
            "near_next": pa.array([jaccard(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        })

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        block, done, chars = None, False, 0
        for batch in batches:
            for b, donor, k, t in zip(*(batch.column(c) for c in ("_block", "_donor", "_key", "_text"))):
                b, donor, k, t = b.as_py(), donor.as_py(), k.as_py(), t.as_py()
                if b != block:
                    block, done, group, chars = b, False, [], 0
                if done:
                    continue
                group.append((k, t))
                chars += len(t)
                # The first given row is the successor of the block's last one.
                done = donor
                if len(group) > 1 and (done or chars > 1 << 20):
                    yield finished(group)
                    group, chars = [group[-1]], len(t)

    dealt = spread.repartition("_block").sortWithinPartitions(
        "_block", "_donor", F.col("_key").desc_nulls_last(), "_text")
    return dealt.select("_block", "_donor", "_key", "_text").mapInArrow(work, columns)
