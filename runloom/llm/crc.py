"""CRC-32 of words and of runs of words, computed for whole arrays of words with NumPy."""

from __future__ import annotations

import zlib

import numpy as np

ONES = np.uint32(0xFFFFFFFF)
# Zero bytes that one table skips at once; longer words take further tables for powers of two.
SHORT = 64
_TABLES: dict[str, np.ndarray] = {}


def _advance(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The linear map that four rows of 256 numbers stand for, one row per byte of the state."""
    out = table[0][state & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _compose(table: np.ndarray) -> np.ndarray:
    """The map taken twice."""
    return np.stack([_advance(row, table) for row in table])


def _tables() -> dict[str, np.ndarray]:
    """The byte table, maps that skip 0 to 63 zero bytes, and maps that skip 64 times powers of two."""
    if not _TABLES:
        byte = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            byte = np.where(byte & 1, (byte >> np.uint32(1)) ^ np.uint32(0xEDB88320), byte >> np.uint32(1)).astype(np.uint32)
        identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        short = [identity]
        for _ in range(SHORT):
            last = short[-1]
            short.append((last >> np.uint32(8)) ^ byte[last & np.uint32(255)])
        powers = [short.pop()]
        for _ in range(26):
            powers.append(_compose(powers[-1]))
        _TABLES["byte"], _TABLES["short"], _TABLES["powers"] = byte, np.stack(short).reshape(-1), np.stack(powers)
    return _TABLES


def skip(state: np.ndarray, length: np.ndarray) -> np.ndarray:
    """States after as many zero bytes as ``length`` says."""
    t = _tables()
    base = (length % SHORT).astype(np.int64) * 1024
    out = t["short"][base + (state & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ t["short"][base + 256 * k + ((state >> np.uint32(8 * k)) & np.uint32(255))]
    more = length // SHORT
    rest = np.flatnonzero(more)
    for bit, table in enumerate(t["powers"]):
        if not len(rest):
            break
        rows = rest[(more[rest] >> bit & 1).astype(bool)]
        out[rows] = _advance(out[rows], table)
        rest = rest[more[rest] >> (bit + 1) > 0]
    return out


def word_states(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """State after each word from an empty one; all words go on by one byte at a time, the longest by themselves."""
    t = _tables()
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-lengths, kind="stable")
    sizes, at = lengths[order], starts[order]
    long = int(np.searchsorted(-sizes, -SHORT, side="left"))
    for i in range(long):
        raw = zlib.crc32(data[at[i]: at[i] + sizes[i]].tobytes())
        # The checksum starts from ones and ends inverted; the start is taken off again.
        start = skip(np.array([ONES], dtype=np.uint32), np.array([sizes[i]]))[0]
        out[order[i]] = np.uint32(raw) ^ ONES ^ start
    state = np.zeros(len(order) - long, dtype=np.uint32)
    at, sizes = at[long:], sizes[long:]
    for k in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, side="left"))
        live = state[:n] ^ data[at[:n] + k]
        state[:n] = (live >> np.uint32(8)) ^ t["byte"][live & np.uint32(255)]
    out[order[long:]] = state
    return out


def run_checksums(states: np.ndarray, lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """CRC-32 of all runs of 1 to ``most`` consecutive words, joined by one space; entry k starts at word k."""
    t = _tables()
    out, state = [], np.full(len(states), ONES, dtype=np.uint32)
    for n in range(most):
        if n:
            state = state[:-1] if len(state) else state
            live = state ^ np.uint32(32)
            state = (live >> np.uint32(8)) ^ t["byte"][live & np.uint32(255)]
        state = skip(state, lengths[n:]) ^ states[n:]
        out.append(state ^ ONES)
    return out
