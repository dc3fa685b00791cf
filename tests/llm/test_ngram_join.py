import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from runloom.llm import ngram_join
from runloom.llm.queries import QUERIES

from .test_shingles import shingle_lists


def brute(rows, size, percent):
    """(key, n, component) with every pair compared."""
    sets = [set(x) for x in shingle_lists([t for _, t in rows], size)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][0] is not None and rows[i][0] == rows[j][0]
            near = a and b and 100 * len(a & b) >= percent * len(a | b)
            if a and b and rows[i][0] is not None and rows[j][0] is not None and (same or near):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets)) if k is not None)


def near_copies(rng, n, length, changes):
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(length)] = f"v{rng.randrange(500)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [3, 512])
@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, block, size, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HELD", 4 * block)
    rng = random.Random(block + size)
    texts = sum([near_copies(rng, 25, n, c) for n, c in [(9, 2), (30, 3), (60, 6), (200, 14)]], [])
    texts += ["common passage of some words that many texts share " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))
              for _ in range(40)]
    texts += [texts[0]] * 30 + [None, "", " ", "one two", "One two", "one"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    got = ngram_join.jaccard_components(docs, words=size, percent=percent, broadcast_ids=0 if block == 3 else 300_000)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, size, percent)


def test_query_equals_brute_force(spark, sf_dir, docs_frame):
    got = QUERIES["op5_ngram_join"](spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == brute(list(zip(docs_frame.doc_id.tolist(), docs_frame.text)), 4, 85)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = ngram_join.jaccard_components(odd_docs).collect()
    assert len(got) == len(rows)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute(rows, 4, 85)
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "4", "5", "6", "8", "9", "None"]
    assert ngram_join.jaccard_components(no_docs).count() == 0 and ngram_join.keep_one(no_docs).count() == 0


def test_rows_of_a_bucket_with_many_blocks(spark, monkeypatch):
    """Sets of one label do not meet, others meet once, and each set seeks one partner over all blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = np.random.default_rng(3)
    n, own, base = 120, 8, rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - k], rng.integers(0, 2**63, k).astype(np.uint64)]))
            for k in rng.integers(0, 25, n)]
    label = [i if i < own else own for i in range(n)]
    buckets = spark.createDataFrame(
        [(7, i, label[i]) for i in range(n)] + [(9, i, label[i]) for i in range(3)], "sig long, set_id long, label long")
    metas = spark.createDataFrame(
        [(i, len(x), bytearray(ngram_join.parity_sketch(x))) for i, x in enumerate(sets)], "set_id long, n_shingles long, sketch binary")
    units = ngram_join._block_units(buckets)
    met, by_unit = defaultdict(int), defaultdict(list)
    rows = units.collect()
    for r in rows:
        by_unit[r.sig, r.low, r.high].append(r)
    for (sig, low, high), members in by_unit.items():
        for a, b in itertools.combinations(members, 2):
            if a.label != b.label and (low == high or a.block != b.block):
                met[sig, *sorted((a.set_id, b.set_id))] += 1
    wanted = {(7, *p) for p in itertools.combinations(range(n), 2)} | {(9, *p) for p in itertools.combinations(range(3), 2)}
    assert dict(met) == {(s, a, b): 1 for s, a, b in wanted if label[a] != label[b]}
    # Two blocks of others and 28 of the frequent label, where all with all would be 30 units for each of the sets.
    assert len(rows) == own * (2 + 28) + (n - own) * 2 + 3
    differ = [[int(np.bitwise_count(np.bitwise_xor(*ngram_join._folded([ngram_join.parity_sketch(x), ngram_join.parity_sketch(y)]))).sum())
               for y in sets] for x in sets]
    pairs = [tuple(r) for r in ngram_join._closest(ngram_join._screened(units, metas, 80)).collect()]
    assert len(pairs) <= n and all(a < b and label[a] != label[b] for a, b in pairs)
    for i in range(n):
        least = min(differ[i][j] for j in range(n) if label[j] != label[i])
        assert any(i in p and differ[p[0]][p[1]] == least for p in pairs)
