import random
import re

import numpy as np

from runloom.llm import chunks
from runloom.llm.queries import QUERIES
from runloom.llm.shingles import mix


def test_cuts_equal_the_rolling_hash():
    rng = random.Random(2)
    text = "".join(rng.choice("ab é漢 the words") for _ in range(5000)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    gear, h, expect = chunks._gear().tolist(), 0, []
    for i, b in enumerate(text):
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        # Only the last 16 bytes count for the top bits of a sum of 16 shifted numbers.
        own = sum(gear[text[i - k]] << k for k in range(16) if i >= k) & 0xFFFFFFFF
        if own >> 28 == 0 and i + 1 < len(text) and text[i + 1] & 0xC0 != 0x80:
            expect.append(i + 1)
    assert chunks.cut_candidates(data).tolist() == expect and mix(np.zeros(1, np.uint64)).shape == (1,)


def test_chunks_join_up_to_the_text(odd_docs):
    texts = {r.doc_id: (r.text or "").encode() for r in odd_docs.collect()}
    got = {}
    for r in chunks.chunk_documents(odd_docs.dropDuplicates(["doc_id"])).collect():
        got.setdefault(r.key, []).append((r.start, r.length))
    assert set(got) == {k for k, t in texts.items() if t and k is not None}
    for k, parts in got.items():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) == len(texts[k]) and max(n for _, n in parts) <= chunks.MOST
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        for a, n in parts:
            texts[k][a: a + n].decode()


def test_shared_passages_are_found_wherever_they_stand(spark, no_docs):
    rng = random.Random(4)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    passage, rows = prose(70), []
    for i in range(60):
        rows.append((i, prose(rng.randrange(30, 90)) + " " + (passage + " " if i % 3 == 0 else "") + prose(rng.randrange(30, 90))))
    rows += [(100, rows[1][1]), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunks.repeated_passages(docs)
    got = found.collect()
    text = {i: (t or "").encode() for i, t in rows}
    assert {r.doc_id for r in got} == {i for i in range(60) if i % 3 == 0} | {1, 100}
    for r in got:
        piece = text[r.doc_id][r.start: r.end]
        assert sum(piece in t for t in text.values()) > 1
        # A single chunk at the edge of a passage may be cut otherwise in the first document.
        assert r.n_chunks == 1 or r.kept == (r.doc_id == min(i for i, t in text.items() if piece in t))
    cut = {r.doc_id: r.text for r in chunks.remove_passages(docs, found).collect()}
    assert cut[100] == "" and cut[1] == rows[1][1] and cut[2] == rows[2][1] and cut[0] == rows[0][1] and cut[101] is None
    for i in range(3, 60, 3):
        assert len(cut[i]) < len(rows[i][1]) - 100 and passage not in cut[i]
    assert chunks.repeated_passages(no_docs).count() == 0


def test_query_spans_are_repeats(spark, sf_dir, docs_frame):
    text = {i: (t or "").encode() for i, t in zip(docs_frame.doc_id, docs_frame.text)}
    got = QUERIES["op10_substring_dedup"](spark, sf_dir).collect()
    for r in got:
        piece = text[r.doc_id][r.start: r.end]
        # A run may be put together from what several places share; its first chunk has 16 bytes.
        assert sum(len(re.findall(b"(?=" + re.escape(piece[:16]) + b")", t)) for t in text.values()) > 1
    copies = {i for i, t in text.items() if len(t) > 400 and sum(t == u for u in text.values()) > 1}
    assert copies <= {r.doc_id for r in got}


def expected_passages(docs, least=100):
    """Rows of repeated_passages by brute force: every chunk's places in order, runs of repeated ones."""
    parts = {(r.key, r.text_hash, r.start, r.length, r.high, r.low) for r in chunks.chunk_documents(docs).collect()}
    first, many = {}, set()
    for key, text_hash, start, _, *digest in sorted(parts, key=lambda p: p[:3]):
        if first.setdefault(tuple(digest), (key, text_hash, start)) != (key, text_hash, start):
            many.add(tuple(digest))
    runs = []
    for key, text_hash, start, length, *digest in sorted(parts, key=lambda p: p[:3]):
        if tuple(digest) not in many:
            continue
        kept = first[tuple(digest)] == (key, text_hash, start)
        if not runs or runs[-1][-1][:2] != (key, text_hash) or runs[-1][-1][3] != start:
            runs.append([])
        if runs[-1] and runs[-1][-1][5] == kept:
            last = runs[-1].pop()
            runs[-1].append((key, text_hash, last[2], start + length, last[4] + 1, kept))
        else:
            runs[-1].append((key, text_hash, start, start + length, 1, kept))
    return sorted((k, a, b, n, kept, h) for run in runs if run[-1][3] - run[0][2] >= least for k, h, a, b, n, kept in run)


def test_repeats_inside_one_document_are_found_and_removed(spark):
    rng = random.Random(9)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    alone, shared = prose(70), prose(70)
    rows = [
        (1, " ".join([prose(40), alone, prose(30), alone, prose(50), alone, prose(20)])),
        # The owner holds the shared passage three times, the other document twice.
        (2, " ".join([prose(20), shared, prose(30), shared, prose(20), shared])),
        (3, " ".join([shared, prose(60), shared, prose(10)])),
        (4, prose(200)),
        # Rows with equal key and text are one document; other texts of a key are not.
        (5, "a row that is there twice " + prose(60)), (6, prose(50) + " " + alone), (6, prose(90)),
    ]
    rows.append(rows[4])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunks.repeated_passages(docs)
    got = found.collect()
    assert sorted(tuple(r) for r in got) == expected_passages(docs)
    assert {r.doc_id for r in got} == {1, 2, 3, 6} and {r.doc_id for r in got if r.kept} == {1, 2}
    cut = {(r.doc_id, r.text) for r in chunks.remove_passages(docs, found).collect()}
    assert {rows[3], rows[4], rows[6]} <= cut and len(cut) == 7
    left = [t for _, t in cut]
    assert sum(t.count(alone) for t in left) == 1 and sum(t.count(shared) for t in left) == 1
    # Of each copy at most a chunk at either end stays.
    assert all(alone[i: i + 100] not in t.replace(alone, "") and shared[i: i + 100] not in t.replace(shared, "")
               for t in left for i in range(len(alone) - 100))


def test_query_equals_brute_force(spark, sf_dir, docs_frame):
    got = QUERIES["op10_substring_dedup"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got and sorted(tuple(r) for r in got) == [r[:5] for r in expected_passages(docs)]
    runs = []
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        if runs and runs[-1][0] == r.doc_id and runs[-1][2] == r.start:
            runs[-1][2] = r.end
        else:
            runs.append([r.doc_id, r.start, r.end])
    assert all(b - a >= 100 for _, a, b in runs)
    texts = [(t or "").encode() for t in docs_frame.text]
    # Copies whose passage stands in no other document.
    assert any(not r.kept and sum(texts[r.doc_id][r.start: r.end] in t for t in texts) == 1 for r in got)


def test_chunks_of_very_many_places_are_split_and_others_move_once(spark):
    rng = random.Random(12)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    common, rare = prose(60), prose(60)
    rows = [(i, " ".join([prose(20), common, prose(20), *([rare] if i % 9 == 0 else []), prose(10)])) for i in range(30)]
    rows += [rows[3], (4, prose(30) + " " + common), (None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = expected_passages(docs.filter("doc_id IS NOT NULL"))
    together = chunks.repeated_passages(docs)
    # Once to the places of equal digest, once to their text.
    assert together._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    for found in (together, chunks.repeated_passages(docs, crowd=5), chunks.repeated_passages(docs, crowd=0)):
        assert sorted(tuple(r) for r in found.collect()) == expected
