import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from runloom.llm import sharding
from runloom.llm.queries import QUERIES


def brute_shard(key, shards):
    best = None
    for s, w in shards:
        seed = xxhash.xxh64(s.to_bytes(8, "little"), seed=42).intdigest()
        h = seed if key is None else xxhash.xxh64(key.encode(), seed=seed).intdigest()
        score = math.log(((h >> 11) + 0.5) / 2**53) / w
        if best is None or (score, -s) > best:
            best = (score, -s)
    return -best[1]


def test_query_equals_brute_force(spark, sf_dir, docs_frame):
    got = {r.doc_id: r for r in QUERIES["op4_sharding"](spark, sf_dir).collect()}
    eight = [(s, 1.0) for s in range(8)]
    for i, t in zip(docs_frame.doc_id.tolist(), docs_frame.text):
        data = (t or "").encode()
        r = got[i]
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (brute_shard(str(i), eight), brute_shard(str(i), [*eight, (8, 1.0)]))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("bucket_rows", [1, 200_000])
def test_odd_rows(odd_docs, monkeypatch, bucket_rows):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    got = sharding.shard_records(odd_docs, [(0, 1.0), (5, 2.5)]).collect()
    assert len(got) == odd_docs.count()
    for s in (0, 5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    one = {r.shard for r in got if r.doc_id == 1}
    assert len(one) == 1 and {r["size"] for r in got if r.doc_id in (3, 4)} == {1}


def test_weights_and_moves(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old = [(0, 1.0), (1, 1.0), (2, 2.0)]
    rows = keys.select(
        sharding.rendezvous_shard(F.col("k"), old).alias("a"),
        sharding.rendezvous_shard(F.col("k"), [(0, 1.0), (1, 3.0), (2, 2.0)]).alias("b"),
        sharding.rendezvous_shard(F.col("k"), old[1:]).alias("c")).collect()
    share = Counter(r.a for r in rows)
    assert abs(share[2] / 4000 - 0.5) < 0.04 and abs(share[0] / 4000 - 0.25) < 0.04
    assert all(r.b in (r.a, 1) for r in rows) and all(r.c == r.a or r.a == 0 for r in rows)


def test_empty_table_and_bad_weights(no_docs):
    assert sharding.shard_records(no_docs, [(0, 1.0)]).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous_shard(F.lit("k"), [(0, 0.0)])
