"""Hashes of words and shingles, and the guarantee of the segment index, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import ngram_join, shingles

TEXTS = ["", None, "  ", "a", "A b", "one two three four five six", "x" * 50, " é ÉÉ\tü\n\x0b z ", " a b c", "a b c d e f g " * 40,
         "end", "ONE two Three four five six"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_lists(texts, size):
    out = []
    for t in texts:
        w = words(t)
        out.append([tuple(w[i: i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("piece", [1 << 20, 7])
@pytest.mark.parametrize("size", [1, 4, 5])
def test_hashes_stand_for_shingles(monkeypatch, piece, size):
    monkeypatch.setattr(shingles, "PIECE", piece)
    monkeypatch.setattr(shingles, "_CACHE", {})
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["ab", "Ab", "c", "dddddddddddddddd", "é"]) for _ in range(rng.randrange(30))) for _ in range(60)]
    hashes, bounds = shingles.shingle_hashes(pa.array(texts), size)
    expect = shingle_lists(texts, size)
    assert np.diff(bounds).tolist() == [len(x) for x in expect]
    names: dict = {}
    for i, own in enumerate(expect):
        for h, s in zip(hashes[bounds[i]: bounds[i + 1]].tolist(), own):
            assert names.setdefault(h, s) == s
    assert len(names) == len({s for own in expect for s in own})


def test_hashes_do_not_depend_on_the_piece(monkeypatch):
    text = pa.array(["word " * 50 + "y" * 200 + " " * 30 + "z", "tail"])
    whole = shingles.word_hashes(text)[0]
    monkeypatch.setattr(shingles, "PIECE", 13)
    monkeypatch.setattr(shingles, "_CACHE", {})
    assert (shingles.word_hashes(text)[0] == whole).all()


def test_slices_of_a_sliced_batch():
    batch = pa.RecordBatch.from_pydict({"t": ["aa", None, "bbbb", "c"]}).slice(1)
    assert [p.column("t").to_pylist() for p in shingles.slices(batch, "t", 3)] == [[None], ["bbbb"], ["c"]]


@pytest.mark.parametrize("sets", [10, 10**5, 10**9])
def test_linked_sets_share_a_signature(sets):
    rng = np.random.default_rng(5)
    edges = ngram_join.band_edges(2000)
    bands = [ngram_join.allocate(a, b - 1, sets) for a, b in zip(edges, edges[1:])]
    assert all(b.plain + 2 * b.near - b.spare > ngram_join.most_difference(b.high) for b in bands)
    for n in [1, 2, 5, 6, 7, 12, 13, 40, 41, 150, 151, 700, 1999]:
        for _ in range(20):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            pool = rng.integers(0, 2**63, n, dtype=np.uint64)
            for drop in range(0, max(1, n // 5) + 1, max(1, n // 20)):
                for add in range(0, max(1, n // 5) + 1, max(1, n // 20)):
                    other = np.unique(np.concatenate([base[drop:], pool[:add]]))
                    own = np.unique(base)
                    if ngram_join.linked(own, other):
                        values = np.concatenate([own, other])
                        rows, sigs = ngram_join.signatures(values, np.array([0, len(own), len(values)]), bands)
                        assert set(sigs[rows == 0].tolist()) & set(sigs[rows == 1].tolist())
                        folded = ngram_join._folded([ngram_join.parity_sketch(own), ngram_join.parity_sketch(other)])
                        assert ngram_join._compatible(len(own), len(other), folded, 85)


def test_most_difference_is_exact():
    for n in range(1, 60):
        brute = max(a + b - 2 * i for a in range(1, n + 1) for b in range(1, n + 1) for i in range(min(a, b) + 1) if 100 * i >= 85 * (a + b - i))
        assert ngram_join.most_difference(n) >= brute >= ngram_join.most_difference(n) - 1
