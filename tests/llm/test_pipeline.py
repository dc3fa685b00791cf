import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from runloom.functions.workspace import materialise
from runloom.llm import mixing, quality
from runloom.llm.registry import held_out, table

from .test_decontaminate import brute as contaminated
from .test_mixing import brute_count
from .test_ngram_join import brute as components
from .test_sharding import brute_shard


def test_stages_equal_brute_force(spark, sf_dir, docs_frame):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        got.append(docs.toPandas())
    assert all(list(g.columns) == columns for g in got[:-1])
    # Each document that the model scores high stays.
    first = table(spark, sf_dir, "documents")
    sample = quality.labelled_sample(first, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    model = quality.fit_quality(sample)
    measure = quality._Measure(model.good, model.bad)
    keep = [1 / (1 + 2.718281828459045 ** -(model.slope * measure.difference(t) + model.intercept)) >= 0.3 for t in docs_frame.text]
    assert sorted(got[0].doc_id) == sorted(docs_frame.doc_id[keep])
    rows = components(list(zip(got[0].doc_id.tolist(), got[0].text)), 5, 80)
    assert sorted(got[1].doc_id) == sorted(k for k, _, c in rows if k == c)
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    gone = {d for d, *_ in contaminated(zip(got[1].doc_id.tolist(), got[1].text), list(zip(items.item_id.tolist(), items.text)))}
    assert sorted(got[2].doc_id) == sorted(set(got[1].doc_id) - gone)
    size = got[2].assign(size=[len(t.encode()) + 1 for t in got[2].text]).groupby("source")["size"].sum()
    power = size ** corpus_pipeline.EXPONENT
    rate = power / power.sum() * size.sum() / size
    expect = [i for i, s in zip(got[2].doc_id, got[2].source) for _ in range(brute_count(rate[s], "mix", str(i)))]
    assert sorted(got[3].doc_id) == sorted(expect)
    assert sorted(zip(got[4].doc_id, got[4].shard)) == sorted((i, brute_shard(str(i), corpus_pipeline.SHARDS)) for i in got[3].doc_id)


def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            assert [c for c in after.columns if c != "shard"] == [c for c in docs.columns if c != "shard"]
            docs = after
        docs.count()


def test_source_rates_follow_the_exponent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rates = mixing.source_rates(docs, corpus_pipeline.EXPONENT, corpus_pipeline.EPOCHS).toPandas()
    assert abs(rates.target.sum() - 1) < 1e-9
    assert abs((rates["size"] * rates.rate).sum() / rates["size"].sum() - corpus_pipeline.EPOCHS) < 1e-9
