"""Importance resampling towards a target distribution of word n-grams, with exact ranks by parallel sorting."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.workspace import materialise
from .crc import run_checksums, word_states
from .shingles import _column_bytes, slices

BUCKETS = 10_000
WORDS = 3
SEED = 42
# Draws: a share of the documents with enough words.
PERCENT, LEAST_WORDS = 5, 20
# Bytes whose words are hashed at once.
PIECE = 1 << 20
# Rows of a segment that one task merges; beyond so many segments they grow, and spill.
SEGMENT_ROWS, MOST_SEGMENTS, SAMPLES = 4096, 1 << 14, 16
# A row's place counts from 2^33 times its run.
RUN_BITS = 33
_CODES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
LETTER = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive pieces that end before a byte that is in no word."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data):
            outside = np.flatnonzero(~LETTER[LOWER[data[end: end + PIECE]]])
            end += int(outside[0]) if len(outside) else len(data[end: end + PIECE])
            if len(outside):
                break
        yield at, end
        at = end


def feature_buckets(texts: pa.Array, most: int = WORDS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(run length, rows, buckets) of all runs of 1 to ``most`` words of whole texts, piece by piece.

    Words are runs of ASCII digits and letters, A-Z in lower case, and of all other than
    ASCII characters. The words before a piece's first are carried over, so a run may cross
    pieces. Null and empty texts have no runs.
    """
    data, rows = _column_bytes(texts)
    begins = np.unique(rows[:-1])
    states, lengths, owners = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at, end in _cuts(data):
        part = LOWER[data[at:end]]
        solid = LETTER[part]
        new_row = np.zeros(len(part) + 1, dtype=bool)
        new_row[begins[np.searchsorted(begins, at): np.searchsorted(begins, end)] - at] = True
        starts = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | new_row[:-1]))
        stops = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | np.append(new_row[1:-1], True))) + 1
        own = np.searchsorted(rows, starts + at, side="right") - 1
        carried = len(states)
        states = np.concatenate([states, word_states(part, starts, stops - starts)])
        lengths, owners = np.concatenate([lengths, stops - starts]), np.concatenate([owners, own])
        for n, sums in enumerate(run_checksums(states, lengths, most), 1):
            last = np.arange(n - 1, len(states))
            keep = (last >= carried) & (owners[: len(last)] == owners[last])
            yield n, owners[last[keep]], (sums[keep] % np.uint32(buckets)).astype(np.int64)
        states, lengths, owners = states[-(most - 1):], lengths[-(most - 1):], owners[-(most - 1):]


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket: one fixed array, added up in the tasks first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, _, found in feature_buckets(part.column("text")):
                    total += np.bincount(found, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    sums = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    # One row per bucket.
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def importance_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of a feature of each bucket: 1000 x the smoothed log ratio of target and source, rounded down."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def score_documents(docs: DataFrame, gains: np.ndarray, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight, score) of every whole text.

    ``weight`` is the sum of the gains of its features, 0 without any. ``score`` adds Gumbel
    noise drawn from seed and key, so that the highest scores are a draw without replacement
    with chances by weight. A null key draws like an empty one; repeated rows score alike.
    """
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, features, weight = np.zeros((3, len(part)), dtype=np.int64)
                for n, owners, found in feature_buckets(part.column("text")):
                    here = np.bincount(owners, minlength=len(part))
                    features += here
                    words += here if n == 1 else 0
                    # Whole numbers far below 2^53 are added exactly.
                    weight += np.bincount(owners, weights=gains[found], minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *[pa.array(c, pa.int64()) for c in (words, features, weight)]],
                    names=["key", "n_words", "n_features", "weight"])

    read = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    counts = [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]
    weighed = read.mapInArrow(weigh, StructType([read.schema["key"], *counts]))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", (F.col("weight") + noise).cast("long"))


def _order(key) -> tuple:
    """A splitter or a row in falling score, then rising key with nulls last, then its place."""
    score, key, place = key
    return (-score, key is None, 0 if key is None else key, place)


def _segments(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``rows`` with the number of splitters that are not after each row."""
    scores = np.array([s[0] for s in splitters], dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = -batch.column("score").to_numpy()
            low, high = np.searchsorted(scores, own, side="left"), np.searchsorted(scores, own, side="right")
            # Only a row with the very score of a splitter needs its key.
            for i in np.flatnonzero(low != high):
                row = _order((batch.column("score")[i].as_py(), batch.column("key")[i].as_py(), batch.column("place")[i].as_py()))
                low[i] = bisect_right(splitters, row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int32())], names=[*batch.schema.names, "segment"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, *StructType.fromDDL("segment int").fields]))


def rank_draws(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``score_documents`` rows with ``rank``: 1, 2, 3, ... for the drawn ones, else null.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) with the
    highest scores are drawn; ties go to the smaller key, a null key last, and repeated rows
    have ranks one after another. Parallel sorting by regular sampling: each partition is
    sorted and written as a run, regular samples of the runs give the splitters, rows are counted
    per segment, and only segments that hold a draw are exchanged, each merged by one
    task and numbered from the count of the segments before it. A row's place breaks all
    ties, so a score or key that many rows share is split like any other. The driver holds
    the samples (at most about 16 per segment and 16,384 segments) and one count per segment.
    """
    enough = F.col("n_words") >= least_words
    ordered = scored.sortWithinPartitions(enough.desc(), F.desc("score"), F.asc_nulls_last("key"))
    runs = materialise(ordered.withColumn("place", F.monotonically_increasing_id()), "runs")
    able = runs.filter(enough)
    total = able.count()
    draws = percent * total // 100
    none = F.lit(None).cast("long").alias("rank")
    out = [F.col(c) for c in ("key", "n_words", "n_features", "weight", "score")]
    if not draws:
        return runs.select(*out, none)
    segments = min(MOST_SEGMENTS, -(-total // SEGMENT_ROWS))
    stride = max(1, total // (segments * SAMPLES))
    run, place = F.shiftright("place", RUN_BITS), F.col("place").bitwiseAND(F.lit((1 << RUN_BITS) - 1))
    samples = sorted(_order(r) for r in able.filter(
        (place + F.pmod(F.xxhash64(run), F.lit(stride))) % stride == 0).select("score", "key", "place").collect())
    splitters = [samples[len(samples) * i // segments] for i in range(1, segments) if samples]
    keyed = able.select("score", "key", "place")
    counts = {r["segment"]: r["count"] for r in _segments(keyed, splitters).groupBy("segment").count().collect()}
    starts, last = [0], 0
    while starts[-1] + counts.get(last, 0) < draws:
        starts.append(starts[-1] + counts.get(last, 0))
        last += 1
    near = able
    if last < len(splitters):
        low, no_key, value, place_ = splitters[last]
        border = F.struct(
            F.lit(low).cast("long"), F.lit(no_key), F.lit(None if no_key else value).cast(runs.schema["key"].dataType),
            F.lit(place_).cast("long"))
        row = F.struct(-F.col("score"), F.col("key").isNull(), F.col("key"), F.col("place"))
        near, far = able.filter(row < border), runs.filter(~enough | ~(row < border))
    else:
        far = runs.filter(~enough)
    merged = Window.partitionBy("segment").orderBy(F.desc("score"), F.asc_nulls_last("key"), "place")
    before = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("segment"))
    ranked = _segments(near, splitters).withColumn("rank", before + F.row_number().over(merged))
    kept = ranked.select(*out, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return kept.unionByName(far.select(*out, none))


def importance_ranks(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every document's key, n_words, n_features, weight, score and rank among the draws.

    Features are hashed runs of 1 to 3 words of all whole texts; the target's texts say which
    are wanted. Empty tables on either side are allowed. Other columns are not read.
    """
    gains = importance_gains(bucket_counts(docs, text), bucket_counts(target, text))
    return rank_draws(score_documents(docs, gains, seed, key, text), percent, least_words).withColumnRenamed("key", key)


def drawn_documents(docs: DataFrame, ranks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ``ranks`` as from ``importance_ranks``.

    A repeated key stays as often as it was drawn, at most; a null key is drawn like any other.
    """
    names = list(docs.columns)
    marked = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own = f"c{names.index(key)}"
    chances = ranks.filter("rank IS NOT NULL").groupBy(F.col(f"`{key}`").alias("drawn")).agg(F.count(F.lit(1)).alias("times"))
    met = marked.join(chances, F.col(own).eqNullSafe(F.col("drawn")))
    values: list[Column] = [F.col(f"c{i}") for i, f in enumerate(marked.schema.fields) if "map" not in f.dataType.simpleString()]
    turn = F.row_number().over(Window.partitionBy(own).orderBy(F.xxhash64(*values)))
    return met.withColumn("turn", turn).filter("turn <= times").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
