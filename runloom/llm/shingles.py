"""Word and shingle hashes of whole Arrow string columns, computed on their bytes with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes hashed at once; longer texts are hashed in pieces that are joined again.
PIECE = 1 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_CACHE: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Powers of the base and its inverse, one random number per byte, and the separators, once per worker."""
    if not _CACHE:
        codes = np.arange(256, dtype=np.uint64)
        lowered = codes + np.where((codes >= 65) & (codes <= 90), 32, 0).astype(np.uint64)
        _CACHE["value"] = mix(lowered + np.uint64(0xD1B54A32D192ED03))
        _CACHE["blank"] = (codes == 32) | ((codes >= 9) & (codes <= 13))
        _CACHE["up"], _CACHE["down"] = _powers(BASE), _powers(INVERSE)
    return _CACHE


def _column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and where each row begins; a null row has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0]: at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, A-Z in lower case, and the row bounds.

    A word's hash is a polynomial over its bytes, read off running sums, and then mixed
    with its length. A word that crosses a piece is put together from its parts.
    """
    t = _tables()
    data, rows = _column_bytes(texts)
    hashes, firsts = [], []
    begins = np.unique(rows[:-1])
    for at in range(0, len(data), PIECE):
        part = data[at: at + PIECE]
        solid = ~t["blank"][part]
        new_row = np.zeros(len(part) + 1, dtype=bool)
        inside = begins[np.searchsorted(begins, at): np.searchsorted(begins, at + len(part))] - at
        new_row[inside] = True
        before = np.empty(len(part), dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | new_row[:-1]))
        after = np.empty(len(part), dtype=bool)
        after[-1] = False
        after[:-1] = solid[1:] & ~new_row[1:-1]
        ends = np.flatnonzero(solid & ~after) + 1
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(t["value"][part] * t["up"][: len(part)], out=sums[1:])
        poly = (sums[ends] - sums[starts]) * t["down"][starts]
        lengths = (ends - starts).astype(np.uint64)
        # The first part goes on with the last word of the piece before?
        if at and len(starts) and starts[0] == 0 and hashes and not new_row[0] and open_end:
            joined = (int(hashes[-1][0][-1]) + int(poly[0]) * pow(BASE, int(hashes[-1][1][-1]), 1 << 64)) & MASK
            hashes[-1][0][-1] = joined
            hashes[-1][1][-1] += lengths[0]
            poly, lengths, starts = poly[1:], lengths[1:], starts[1:]
        if len(part):
            open_end = bool(solid[-1])
        if len(poly) or not hashes:
            hashes.append([poly, lengths])
            firsts.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    poly, lengths = (np.concatenate([h[k] for h in hashes]) for k in (0, 1))
    return mix(poly + mix(lengths)), np.searchsorted(np.concatenate(firsts), rows)


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of every row, with repeats, and the row bounds.

    A row with fewer words has one shingle, all its words; a row without words has none.
    """
    words, rows = word_hashes(texts)
    counts = np.diff(rows)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    factors = [pow(BASE, 3 * k + 1, 1 << 64) for k in range(size)]
    out = np.empty(bounds[-1], dtype=np.uint64)
    if len(words) >= size:
        whole = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k, f in enumerate(factors):
            whole += words[k: len(words) - size + 1 + k] * np.uint64(f)
        whole = mix(whole + np.uint64(size))
        row = np.repeat(np.arange(len(counts)), counts)[: len(whole)]
        keep = np.arange(len(whole)) + size <= rows[1:][row]
        long_rows = np.repeat(counts >= size, runs)
        out[long_rows] = whole[keep]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[rows[i]: rows[i + 1]]
        total = sum(int(w) * f for w, f in zip(own, factors)) & MASK
        out[bounds[i]] = mix(np.array([(total + len(own)) & MASK], dtype=np.uint64))[0]
    return out, bounds


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes of text each, one row at least."""
    column = batch.column(text)
    sizes = np.diff(_column_bytes(column)[1])
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield batch.slice(start)
