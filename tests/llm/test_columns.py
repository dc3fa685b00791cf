"""Operators on tables whose other columns have dots, maps, or names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from runloom.llm import chunks, mixing, ngram_join, quality

INNER = ["_doc", "_hash", "_key", "_source", "_gone", "_again", "_cuts", "_parts", "_below", "_unused", "_copy", "_order",
         "c0", "c1", "key", "start", "end", "size", "set_id", "label", "a.b"]


@pytest.fixture(scope="module")
def strange(odd_docs):
    """The odd rows with columns of these names, a map, and a struct that holds one."""
    more = {c: F.lit(f"{c} kept") for c in INNER}
    entries = F.create_map(F.lit("k"), F.col("doc_id"))
    return odd_docs.drop("score", "copy", "shard").withColumns(
        more | {"some map": entries, "nested": F.struct(entries.alias("m"), F.lit(1).alias("x.y"))})


def same_columns(got, strange, made=()):
    assert got.columns == [*strange.columns, *made]
    for r in got.collect():
        values = dict(zip(got.columns, r))
        assert all(values[c] == f"{c} kept" for c in INNER)
        assert values["some map"] == {"k": values["doc_id"]} and values["nested"]["m"] == values["some map"]
    return got


def test_quality(spark, strange):
    labels = spark.createDataFrame([(i, i % 2, "x", {"k": 1}) for i in range(1, 11)], "doc_id long, quality int, `a.b` string, m map<string,int>")
    model = quality.fit_quality(quality.labelled_sample(strange, labels, F.lit(True)))
    got = same_columns(quality.score_quality(strange, model), strange, ["score"])
    assert got.count() == strange.count() and got.filter("score BETWEEN 0 AND 1").count() == got.count()


def test_keep_one(strange):
    got = same_columns(ngram_join.keep_one(strange), strange)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect() if r.doc_id is not None)
    # 1 stands twice and equals 2; 6 and 7 are equal.
    assert ids == [1, 3, 4, 5, 6, 8, 9, 10] and got.filter("doc_id IS NULL").count() == 1
    links = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(strange).collect()}
    assert links[2] == 1 and links[7] == 6 and links[9] == 9


def test_mixing(strange):
    rates = mixing.source_rates(strange, 0.5, 20.0)
    got = same_columns(mixing.mix_sources(strange, rates), strange, ["copy", "order_key"]).collect()
    again = mixing.mix_sources(strange.select("doc_id", "text", "source"), rates).select("doc_id", "copy", "order_key")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert got and sorted(((r.doc_id, r.copy, r.order_key) for r in got), key=key) == sorted(map(tuple, again.collect()), key=key)


def test_passages(strange):
    twice = strange.withColumn("text", F.when(F.col("doc_id").isin(9, 10), F.repeat(F.md5(F.lit("x")), 40)).otherwise(F.col("text")))
    found = chunks.repeated_passages(twice)
    got = same_columns(chunks.remove_passages(twice, found), strange)
    assert got.count() == strange.count() and found.filter("NOT kept").count() > 0
    assert {r.doc_id for r in found.collect()} >= {9, 10}


def test_empty_tables(strange):
    none = strange.filter("false")
    assert same_columns(ngram_join.keep_one(none), strange).count() == 0
    assert same_columns(chunks.remove_passages(none, chunks.repeated_passages(none)), strange).count() == 0
    assert mixing.mix_sources(none, mixing.source_rates(none, 0.5, 1.0)).count() == 0
