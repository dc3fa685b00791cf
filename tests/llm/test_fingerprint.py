import hashlib

import numpy as np
import pyarrow as pa
import pytest

from runloom.llm import fingerprint
from runloom.llm.queries import QUERIES

from .test_shingles import shingle_lists


def brute(rows):
    """{key: (n_chars, sha)} by the rule of the edit."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [1, 3, 5000])
def test_edits_of_odd_rows(odd_docs, no_docs, monkeypatch, block_rows):
    monkeypatch.setattr(fingerprint.with_neighbour_blocks, "__defaults__", (block_rows,))
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    got = fingerprint.fingerprint_edits(odd_docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    marks = {}
    for r in got:
        marks.setdefault((r.n_chars, r.doc_id if r.n_chars == 0 else None), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {""}
    assert len({r.fingerprint for r in got if r.doc_id in (6, 7)}) == 1
    assert fingerprint.fingerprint_edits(no_docs).count() == 0


def test_query_equals_brute_force(spark, sf_dir, docs_frame):
    got = QUERIES["op7_fingerprints"](spark, sf_dir).collect()
    rows = list(zip(docs_frame.doc_id.tolist(), docs_frame.text.fillna("")))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    texts = dict(rows)
    by = {r.doc_id: r for r in got}
    order = sorted(texts, reverse=True)
    error = []
    for i, k in enumerate(order):
        t, after = texts[k], texts[order[(i + 1) % len(order)]]
        n = len(t) // 3
        a, e, b = (set(x) for x in shingle_lists([t, t[: len(t) - n] + after[:n], after], 5))
        exact = len(a & e) / len(a | e) if a | e else 1.0
        if len(a) > 200:
            error.append(abs(by[k].near_edited - exact))
            assert abs(by[k].near_next - len(a & b) / len(a | b)) < 0.2
        if max(len(a), len(e)) <= fingerprint.KEEP:
            assert abs(by[k].near_edited - exact) < 1e-12
        assert by[k].near_edited > 0 or exact <= 0.2
    assert np.mean(error) < 0.08


def test_sketches_merge_and_estimate_containment():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 6000)]
    whole, part, rest = " ".join(words), " ".join(words[1000:1400]), " ".join(words[996 + 400:])
    a, b, c = fingerprint.sketches(pa.array([whole, part, rest]))
    assert fingerprint.containment(b, a) == 1.0 and fingerprint.containment(a, b) < 0.15
    merged = fingerprint.merge(fingerprint.sketches(pa.array([" ".join(words[:1400])]))[0], c)
    assert (merged == a).all()
    assert (fingerprint.decode(fingerprint.encode(a)) == a).all()
    e = np.zeros(0, np.uint64)
    assert fingerprint.jaccard(e, e) == 1.0 and fingerprint.jaccard(a, e) == 0.0 and (fingerprint.merge(e, b) == b).all()


def test_documents_keep_their_fingerprint(odd_docs):
    got = fingerprint.fingerprint_documents(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.n_hashes for r in got if r.doc_id in (3, 4, 5)} == {0}


def test_likeness_at_all_lengths():
    rng = np.random.default_rng(2)
    for n in [1, 3, 5, 6, 8, 12, 20, 40, 80, 130, 200, 260, 400, 600, 1200, 3000]:
        words = [f"w{i}" for i in rng.integers(0, 10**6, n)]
        swapped = [*words[: n - n // 5], *(f"v{i}" for i in range(n // 5))]
        texts = [" ".join(words), " ".join(swapped), " ".join(words * 2)]
        sets = [set(x) for x in shingle_lists(texts, 5)]
        made = fingerprint.sketches(pa.array(texts))
        for i in range(3):
            assert len(made[i]) - 1 <= fingerprint.KEEP or made[i][0] == fingerprint.SCALE
            for j in range(3):
                exact = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                got = fingerprint.jaccard(made[i], made[j])
                assert abs(got - exact) < (1e-12 if max(map(len, sets)) <= fingerprint.KEEP else 0.15)
                assert got > 0 or exact <= 0.2
        if n >= 5:
            both = fingerprint.sketches(pa.array([texts[0], texts[1] + " . " + texts[0]]))
            assert (fingerprint.merge(both[0], both[1]) == both[1]).all()


def test_short_items_in_long_texts():
    rng = np.random.default_rng(3)
    unknown = 0
    for _ in range(100):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 2000)]
        at = int(rng.integers(0, 1988))
        texts = pa.array([" ".join(words), " ".join(words[at: at + 12]), " ".join(f"v{i}" for i in range(12))])
        whole, item, other = fingerprint.sketches(texts)
        share = fingerprint.containment(item, whole)
        unknown += np.isnan(share)
        assert np.isnan(share) or share == 1.0
        fine = fingerprint.sketches(texts, scale=1)
        assert fingerprint.containment(item, fine[0]) == 1.0 and fingerprint.containment(other, fine[0]) == 0.0
    assert unknown < 60


def test_keys_are_integers(spark):
    with pytest.raises(TypeError):
        fingerprint.fingerprint_edits(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
