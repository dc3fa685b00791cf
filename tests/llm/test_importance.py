import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runloom.llm import crc, importance
from runloom.llm.queries import QUERIES


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(words[i: i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target, percent=5, least=20):
    """(id, n_features, weight, score, rank) by the definition, with Python's own checksums and sort."""
    s, t, found = Counter(), Counter(), [features(x) for _, x in docs]
    for _, f in found:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    rows = []
    for (i, _), (n, f) in zip(docs, found):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(map(lambda r: tuple(r[:5]), rows), key=str)


def rows_of(df, key="doc_id"):
    return sorted(((r[key], r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir, docs_frame):
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet").text.tolist()
    got = QUERIES["op11_importance_resampling"](spark, sf_dir)
    assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert rows_of(got) == brute(list(zip(docs_frame.doc_id.tolist(), docs_frame.text)), items)


def test_odd_rows_equal_brute_force(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the lazy dog runs away",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = importance.importance_ranks(odd_docs, target, percent=60, least_words=3)
    assert rows_of(got) == brute(rows, ["the lazy dog runs away", None, ""], 60, 3)
    drawn = importance.drawn_documents(odd_docs, got)
    assert drawn.columns == odd_docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in got.collect() if r["rank"])
    assert importance.importance_ranks(no_docs, target).count() == 0
    assert rows_of(importance.importance_ranks(odd_docs, target.filter("false"), 100, 1)) == brute(rows, [], 100, 1)


@pytest.mark.parametrize("percent", [0, 1, 5, 50, 100])
def test_ranks_are_those_of_a_full_sort(spark, monkeypatch, many_partitions, percent):
    monkeypatch.setattr(importance, "SEGMENT_ROWS", 64)
    monkeypatch.setattr(importance, "SAMPLES", 4)
    scored = spark.range(5000, numPartitions=13).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id")).alias("key"),
        (F.col("id") % 40).alias("n_words"), F.col("id").alias("n_features"), F.col("id").alias("weight"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(300))).cast("long").alias("score"))
    got = importance.rank_draws(scored, percent).toPandas()
    assert sorted(got.weight) == list(range(5000))
    able = got[got.n_words >= 20].sort_values(["score", "key"], ascending=[False, True], na_position="last")
    draws = percent * len(able) // 100
    drawn = got[got["rank"].notna()].sort_values("rank")
    assert drawn["rank"].tolist() == list(range(1, draws + 1))
    same = [(a, b) if not (np.isnan(b)) else (a, None) for a, b in zip(able.score[:draws], able.key[:draws])]
    assert same == [(a, b) if not (np.isnan(b)) else (a, None) for a, b in zip(drawn.score, drawn.key)]


def test_segments_share_the_rows(spark, monkeypatch):
    monkeypatch.setattr(importance, "SEGMENT_ROWS", 200)
    sizes = []
    whole = importance._segments

    def watched(rows, splitters):
        out = whole(rows, splitters)
        if splitters and not sizes:
            sizes.extend(r["count"] for r in out.groupBy("segment").count().collect())
        return out

    monkeypatch.setattr(importance, "_segments", watched)
    # A third of all rows is one row, repeated.
    scored = spark.range(6000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("key"), F.lit(30).cast("long").alias("n_words"),
        F.lit(1).cast("long").alias("n_features"), F.lit(1).cast("long").alias("weight"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 11).cast("long").alias("score"))
    importance.rank_draws(scored, 50).count()
    assert sum(sizes) == 6000 and max(sizes) < 3 * 200


def test_pieces_and_checksums(monkeypatch):
    draw = random.Random(3)
    words = ["".join(draw.choices("abÀé漢09Z", k=draw.choice([1, 2, 5, 64, 65, 130, 3000]))) for _ in range(200)]
    texts = [" ".join(words[:120]), "", None, ", ".join(words[120:]), "x", "A　B C"]
    expect = [sorted(features(t)[1]) for t in texts]
    for piece in (7, 100, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", piece)
        got = [[] for _ in texts]
        for _, owners, found in importance.feature_buckets(pa.array(texts)):
            for o, b in zip(owners, found):
                got[o].append(int(b))
        assert [sorted(g) for g in got] == expect
    data = np.frombuffer("".join(words).encode(), np.uint8)
    sizes = np.array([len(w.encode()) for w in words])
    states = crc.word_states(data, np.cumsum(sizes) - sizes, sizes)
    assert crc.run_checksums(states, sizes, 1)[0].tolist() == [zlib.crc32(w.encode()) for w in words]
