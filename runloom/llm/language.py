"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import map_columns
from .shingles import slices

DIMS = 1024
SEED = 7
# Learned documents per language (on average) and the number of languages a model may have.
SAMPLE_ROWS = 1000
MOST_LANGUAGES = 2000
# Texts longer than this are read in pieces that overlap by two symbols.
PIECE_CHARS = 1 << 20
# Cells of one counts matrix (rows x distinct n-grams).
CELLS = 6_000_000
UNKNOWN = "und"

_LETTERS: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """The random vector of -1 and 1 that stands for a letter, the same in every worker."""
    if code not in _LETTERS:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMS, dtype=np.int8)
        _LETTERS[code] = bits * np.int8(2) - np.int8(1)
    return _LETTERS[code]


def _pieces(text: str) -> Iterator[str]:
    """Parts of the padded, lower-cased text whose trigrams together are those of the whole.

    A part begins with the last two symbols of what came before it, so each trigram over a
    cut is in just one part.
    """
    text = f" {text.lower()} "
    before = ""
    for at in range(0, len(text), PIECE_CHARS):
        part = before + text[at: at + PIECE_CHARS]
        yield part
        last = len(part)
        if not part[-1].isalpha():
            while last and not part[last - 1].isalpha():
                last -= 1
            before = part[last - 1: last] + " "
        else:
            before = part[-2:] if len(part) < 2 or part[-2].isalpha() else " " + part[-1]


def _ngrams(padded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and code of each letter trigram; the letters; which rows have a letter.

    Letters are in lower case, every run of other characters is one blank, also before the
    first and after the last letter.
    """
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    seen = np.zeros(0x110000, dtype=bool)
    seen[codes] = True
    letters = np.array([c for c in np.flatnonzero(seen) if chr(c).isalpha()], dtype=np.int64)
    place = np.zeros(0x110000, dtype=np.int64)
    place[letters] = np.arange(1, len(letters) + 1)
    symbol = place[codes]
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    keep[0] = True
    keep[1:] |= rows[1:] != rows[:-1]
    symbol, rows = symbol[keep], rows[keep]
    with_letter = np.zeros(len(padded), dtype=bool)
    with_letter[rows[symbol > 0]] = True
    base = len(letters) + 1
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters, with_letter
    inside = rows[:-2] == rows[2:]
    code = (symbol[:-2] * base + symbol[1:-1]) * base + symbol[2:]
    return rows[:-2][inside], code[inside], letters, with_letter


def _ngram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: the first letter permuted twice, the second once, the third not."""
    base = len(letters) + 1
    table = np.stack([letter_vector(32), *map(letter_vector, letters.tolist())])
    once, twice = np.roll(table, 1, axis=1), np.roll(table, 2, axis=1)
    return (twice[codes // (base * base)] * once[codes // base % base] * table[codes % base]).astype(np.float32)


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bundle (sum) of all trigram vectors of each whole text, and whether it has a letter."""
    owner, parts = [], []
    for i, t in enumerate(texts):
        for piece in _pieces(t or ""):
            owner.append(i)
            parts.append(piece)
    out = np.zeros((len(texts), DIMS), dtype=np.float64)
    has = np.zeros(len(texts), dtype=bool)
    if not parts:
        return out, has
    rows, codes, letters, with_letter = _ngrams(parts)
    np.logical_or.at(has, owner, with_letter)
    owner = np.array(owner)[rows]
    base = len(letters) + 1
    if base**3 <= 1 << 23:
        seen = np.zeros(base**3, dtype=bool)
        seen[codes] = True
        distinct = np.flatnonzero(seen)
        place = np.zeros(base**3, dtype=np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        place = place[codes]
    else:
        distinct, place = np.unique(codes, return_inverse=True)
    if not len(distinct):
        return out, has
    # Tiles of rows and of n-grams keep both matrices small.
    wide = 1 << 14
    tall = max(1, CELLS // min(wide, len(distinct)))
    bounds = np.searchsorted(owner, np.arange(0, len(texts) + tall, tall))
    for left in range(0, len(distinct), wide):
        vectors = _ngram_vectors(distinct[left: left + wide], letters)
        width = len(vectors)
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            at = place[a:b] - left
            inside = (at >= 0) & (at < width)
            height = min(tall, len(texts) - k * tall)
            cells = (owner[a:b][inside] - k * tall) * width + at[inside]
            counts = np.bincount(cells, minlength=height * width).reshape(height, width).astype(np.float32)
            out[k * tall: k * tall + height] += counts @ vectors
    return out, has


def learn_languages(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS,
) -> dict[str, np.ndarray]:
    """Prototype of each language: the normalised bundle of about ``rows`` documents with that language.

    Rows are counted per language, then those whose key hash is below the language's share
    are read: no language is ordered or gathered. Vectors are added up per task before
    they are combined. Rows with a null language, key or text are not learned from.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & learn)
    # One row per language, their number is checked as they are fetched.
    counts = usable.groupBy(F.col(lang).alias("_lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"the model holds at most {MOST_LANGUAGES} languages")
    shares = docs.sparkSession.createDataFrame(
        [(r["_lang"], rows / r["count"]) for r in counts], "_lang string, _share double")
    drawn = F.pmod(F.xxhash64(key), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = usable.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), drawn.alias("_u")).join(
        F.broadcast(shares), "_lang").filter("_u < _share")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "_text"):
                vectors, _ = text_vectors(part.column("_text").to_pylist())
                for name, v in zip(part.column("_lang").to_pylist(), vectors):
                    sums[name] = sums.get(name, 0.0) + v
        if sums:
            yield pa.RecordBatch.from_pydict({
                "lang": [n for n in sums for _ in range(DIMS)], "dim": pa.array(list(range(DIMS)) * len(sums), pa.int32()),
                "value": np.concatenate(list(sums.values()))})

    added = sample.select("_lang", "_text").mapInArrow(bundle, "lang string, dim int, value double")
    totals: dict[str, np.ndarray] = {}
    # One number per language and dimension.
    for r in added.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect():
        totals.setdefault(r["lang"], np.zeros(DIMS))[r["dim"]] = r["value"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(totals.items()) if np.any(v)}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the nearest prototype (0 if negative).

    A null text, a text without letters and any text under a model without languages are
    ``und`` with score 0. Ties go to the language that is first in order. Other columns pass
    through, those named like a result column are replaced.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names], axis=1) if names else np.zeros((DIMS, 0))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            for part in slices(batch, "text"):
                vectors, has = text_vectors(part.column("text").to_pylist())
                length = np.linalg.norm(vectors, axis=1)
                if names:
                    cosine = np.round(vectors @ matrix / np.where(length > 0, length, 1.0)[:, None], 9)
                    best, top = cosine.argmax(axis=1), cosine.max(axis=1)
                    guess = [names[b] if h else UNKNOWN for b, h in zip(best, has)]
                    score = np.where(has, np.clip(top, 0.0, 1.0), 0.0)
                else:
                    guess, score = [UNKNOWN] * len(has), np.zeros(len(has))
                yield part, [pa.array(guess, pa.string()), pa.array(score, pa.float64())]

    return map_columns(docs, text, "lang_pred string, score double", predict)
