"""Quality scores from compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_columns

# Labelled rows per class that a model is fitted on, and the longest of them in bytes.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32 << 10
DICTIONARY_BYTES = 256 << 10
# Texts are compressed in short blocks, so that their own history does not hide the dictionary.
BLOCK_BYTES = 512
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the logistic curve over the normalised size difference."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float


class _Measure:
    """Compressed sizes under both dictionaries; lives in one worker."""

    def __init__(self, good: bytes, bad: bytes):
        self.packers = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO),
                write_content_size=False, write_dict_id=False)
            for d in (good, bad)
        ]

    def difference(self, text: str | None) -> float:
        """(bad - good) / (bad + good) over the whole text; 0 for an empty one."""
        data = (text or "").encode()
        sizes = [
            sum(len(p.compress(data[i: i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES)) for p in self.packers]
        return (sizes[1] - sizes[0]) / (sizes[0] + sizes[1]) if data else 0.0


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; the text itself where there is too little to train on."""
    blocks = [t.encode()[i: i + BLOCK_BYTES] for t in texts for i in range(0, len(t.encode()), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of a slightly ridged logistic regression, by Newton steps.

    Rows weigh as much as gives label 1 its ``share`` among all labelled rows, whatever its
    share of the sample.
    """
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        slope = design.T @ (weight * (y - p)) - np.array([1e-2, 0]) * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text",
    label: str = "quality", rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES,
) -> DataFrame:
    """(key, text, label, share) of at most ``rows`` documents per label, those with the smallest key hash.

    Only the ids are ordered; at most 2 x ``rows`` of them are sent to all tasks, where
    they meet the documents. Ids with both labels or a null label are not used, nor texts
    over ``longest`` bytes. ``share`` is that of label 1 among all usable labels.
    """
    agreed = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(key).agg(
        F.min(label).alias("label"), F.max(label).alias("_most")).filter("label = _most").drop("_most")
    share = agreed.agg(F.avg("label")).first()[0]
    order = [F.xxhash64(key), F.col(key)]
    chosen = [agreed.filter(F.col("label") == c).orderBy(*order).limit(rows) for c in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(key), F.col(text).alias("text")).filter(F.octet_length("text") <= longest)
    # A document that is there twice is read once.
    return texts.join(F.broadcast(ids), key).groupBy(key, "label").agg(F.min("text").alias("text")).withColumn(
        "share", F.lit(share).cast("double"))


def fit_quality(sample: DataFrame, key: str = "doc_id") -> QualityModel:
    """Dictionaries from half of the bounded sample, calibration on the other half.

    Without labels of both classes the model scores every text 0.5.
    """
    rows = sorted((r[key], r["label"], r["text"], r["share"]) for r in sample.select(key, "label", "text", "share").collect())
    parts = {c: [t for _, y, t, _ in rows if y == c and t] for c in (0, 1)}
    good, bad = (_dictionary(parts[c][0::2]) for c in (1, 0))
    measure = _Measure(good, bad)
    held = [(measure.difference(t), c) for c in (0, 1) for t in parts[c][1::2]]
    if len({c for _, c in held}) < 2:
        return QualityModel(good, bad, 0.0, 0.0)
    x, y = (np.array(v, dtype=float) for v in zip(*held))
    return QualityModel(good, bad, *_logistic(x, y, rows[0][3]))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text.

    Null and empty texts have no size difference and get the score of 0. Repeated rows get
    equal scores; other columns pass through whatever their names and types, one named like
    the result is replaced.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        measure = _Measure(model.good, model.bad)
        for batch in batches:
            x = np.array([measure.difference(t.as_py()) for t in batch.column("text")], dtype=float)
            made = 1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -50, 50)))
            yield batch, [pa.array(made, pa.float64())]

    return map_columns(docs, text, f"`{out}` double", score)
