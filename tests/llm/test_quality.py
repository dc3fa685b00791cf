import zlib

import pandas as pd
from pyspark.sql import functions as F

from runloom.llm import quality
from runloom.llm.queries import QUERIES
from runloom.llm.registry import held_out


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = QUERIES["op3_quality"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    met = got[got.held_out].merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert (met.predicted == met.quality).mean() > 0.9
    assert met[met.quality == 1].predicted.mean() > 0.95


def test_score_depends_on_the_text_alone(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(2, 1, "x"), (6, 0, "x"), (7, 0, "x"), (10, 1, "x"), (1, 1, "x"), (1, 0, "x"), (8, None, "x"), (99, 1, "x"), (None, 1, "x")],
        "doc_id long, quality int, text string")
    sample = quality.labelled_sample(odd_docs, labels, F.lit(True))
    assert {(r.doc_id, r.label) for r in sample.collect()} == {(2, 1), (6, 0), (7, 0), (10, 1)}
    model = quality.fit_quality(sample)
    scored = quality.score_quality(odd_docs, model)
    assert scored.columns == [c for c in odd_docs.columns if c != "score"] + ["score"]
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert len({r.score for r in rows if r.doc_id in (6, 7)}) == 1
    assert quality.score_quality(no_docs, model).count() == 0


def test_sample_is_bounded_and_leaves_out_held_rows(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.labelled_sample(docs, labels, ~held_out(F.col("doc_id")), rows=40).collect()
    assert len(got) == 80 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


def test_without_labels_scores_are_neutral(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit_quality(quality.labelled_sample(odd_docs, none, F.lit(True)))
    assert {r.score for r in quality.score_quality(odd_docs, model).collect()} == {0.5}
