"""Registered queries against their SQL on the smallest tables.

``python -m tests.oracle 0.01`` runs all of them; here one query per family keeps the
suite short.
"""

import pytest

import __spark_entry__ as contract
from runloom.plans import registry
from tests.oracle import connect, differences

CHECKED = [
    "campaign_report", "pce_sobol_second", "pce_evaluation", "qmc_sobol", "descriptive_statistics",
    "prepared_outputs", "positional_block_means", "front_padded_points", "sweep_difference", "parameter_table",
    "tensor_design", "sparse_design", "random_design", "elastic_moduli", "surrogate_errors", "gradient_sensitivity",
    "thermo_log_scan", "nano_history_scan", "campaign_store", "similar_embeddings", "history_mapping",
    "total_sensitivity", "train_test_split",
    "sc_sobol_total", "sc_sobol_second", "sc_sobol_with_gaps", "qmc_sobol_second", "weighted_statistics", "sparse_moments",
    "sparse_sobol", "sparse_sobol_second", "sparse_predictions",
    "qmc_sobol_with_gaps", "sc_interpolation", "surrogate_total_sensitivity", "surrogate_predictions", "run_status",
]
ROWS_ONLY = {
    "active_subspace_errors", "active_subspace_sensitivity", "gaussian_process_errors",
    "gaussian_process_sensitivity", "softmax_errors", "softmax_sensitivity",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, con, name):
    got = contract.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    assert differences(got, con.execute(contract.oracle_sql()[name]).df()) == []


def test_every_query_has_sql_but_the_iterative_fits():
    assert set(registry.QUERIES) - set(registry.SQL) == ROWS_ONLY
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", ["active_subspace_errors", "gaussian_process_sensitivity"])
def test_surrogate_queries_give_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() == 4


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["qoi", "t", "mean", "std", "param", "sobol"] and df.count() == 28


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        frames = []
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            frames.append(contract.queries()["prepared_outputs"](spark, sf_dir).toPandas())
        assert differences(*frames) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_skewed_group_gives_the_same_moments(spark):
    """A third of all rows in one (qoi, t): salted joins change nothing."""
    import numpy as np
    from pyspark.sql import functions as F

    from runloom.operators import uq

    rng = np.random.default_rng(9)
    rows = [("hot", 0, float(v), 1.0) for v in rng.normal(5, 2, 500)]
    rows += [(f"q{i}", t, float(v), 1.0) for i in range(10) for t in range(10) for v in rng.normal(i, 1, 10)]
    df = spark.createDataFrame(rows, "qoi string, t int, value double, weight double").repartition(16)
    got = {(r.qoi, r.t): (r["mean"], r["var"]) for r in uq.weighted_moments(df).collect()}
    hot = np.array([r[2] for r in rows if r[0] == "hot"])
    assert np.allclose(got["hot", 0], (hot.mean(), hot.var())) and len(got) == 101
    assert uq.histogram(df).agg(F.sum("count")).first()[0] == 1500
