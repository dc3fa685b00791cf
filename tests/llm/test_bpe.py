import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm import bpe
from runloom.llm.columns import repeat_rows
from runloom.llm.queries import QUERIES, TOKENIZER

CONFIG = bpe.tokenizer_config(path(TOKENIZER))
ENCODER = bpe.Encoder(CONFIG)
WHOLE = Tokenizer.from_str(CONFIG)
ODD = ("abAB .,'s'RE1é漢字́ẞİΣJ̌ 　\x1c\x85​#🙂\n\t\x0b")


def library(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_query_equals_the_library(spark, sf_dir, docs_frame):
    got = {r.doc_id: r for r in QUERIES["op13_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs_frame)
    for i, text in zip(docs_frame.doc_id, docs_frame.text):
        ids = library(text)
        decoded = WHOLE.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "an", "the", "ing", "s", "in", "aaaa", "zz", "Ġ", "é", "ä¸Ń", "th", "!", "!!"]), min_size=2, max_size=120),
       st.integers(1, 7), st.integers(1, 9))
def test_tree_equals_the_whole_word(parts, leaf, window):
    word = "".join(parts)
    old, bpe.WINDOW = bpe.WINDOW, window
    try:
        pieces = [ENCODER.symbols(p) for p in ENCODER.halves(word, leaf)]
        assert ENCODER.tree(pieces) == ENCODER.symbols(word)
    finally:
        bpe.WINDOW = old


def test_long_runs_of_letters():
    draw = random.Random(11)
    for alphabet in ("a", "ab", "etaoinshrdlu", "0ķè"):
        word = "".join(draw.choices(alphabet, k=20_000))
        assert ENCODER.tree([ENCODER.symbols(p) for p in ENCODER.halves(word, 64)]) == ENCODER.symbols(word)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ODD, max_size=60), st.sampled_from(["", "<|endoftext|>", "x<|startoftext|>y", "<|endoftext"]))
def test_odd_texts(text, special):
    old, bpe.LEAF = bpe.LEAF, 4
    try:
        whole = text + special + text
        assert bpe.Encoder(CONFIG).texts(pa.array([whole, None, whole])).to_pylist() == [library(whole), [], library(whole)]
    finally:
        bpe.LEAF = old


@pytest.mark.parametrize("piece", [16, 200, 1 << 16])
def test_cut_texts_equal_the_library(spark, odd_docs, no_docs, many_partitions, piece):
    draw = random.Random(5)
    long = ["".join(draw.choices("abcdefghij", k=3000)), "漢字かな" * 400 + "。" + "x" * 500 + "<|endoftext|>" + "'s!?" * 200,
            " ".join("".join(draw.choices("aeiou'.", k=draw.randrange(1, 90))) for _ in range(400)), "!" * 2000, "　".join(["été"] * 300)]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(long)] + [(100, long[0]), (None, long[1])], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    got = bpe.encode_texts(docs, CONFIG, piece=piece)
    expect = Counter((r.doc_id, tuple(library(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == expect
    assert bpe.encode_texts(no_docs, CONFIG).count() == 0


def test_decoding_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, library("Hello <|endoftext|> world"), {"k": 1}, 2), (2, [], None, 3), (3, None, None, 4)],
                                 "`a.b` long, ids array<int>, m map<string,int>, decoded int")
    got = bpe.decode_ids(rows, CONFIG)
    assert got.columns == ["a.b", "ids", "m", "decoded"]
    assert [r.decoded for r in got.collect()] == ["hello</w> <|endoftext|> world</w>", "", None]


def test_repeated_rows_are_dealt_out(spark, many_partitions):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10_000)], "k string, n long")
    got = repeat_rows(rows, "n", block=100)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 1, "b": 3, "c": 10_000}
    largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 5000
