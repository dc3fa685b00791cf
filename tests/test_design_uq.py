import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.functions.polynomials import Marginal
from runloom.operators import collate, design, uq
from runloom.plans import uq_queries

X1, X2 = Marginal("x1", 0.0, 1.0), Marginal("x2", 1.0, 3.0)
MS = [X1, X2]
def value():
    return F.col("x1") + 2 * F.col("x2") + F.col("x1") * F.col("x2")



def campaign(spark, ms=MS):
    return design.campaign_row(spark, ms)


def golden(spark):
    runs = design.tensor_design(campaign(spark), MS, 3)
    return runs.select("run_id", "x1", "x2", "weight", F.lit("f").alias("qoi"), F.lit(0).alias("t"), value().alias("value"))


def test_tensor_grid(spark):
    rows = design.tensor_design(campaign(spark), MS, 3).orderBy("run_id").collect()
    assert len(rows) == 16 and np.isclose(sum(r.weight for r in rows), 1)
    assert rows[1].node_idx == [0, 1] and rows[4].node_idx == [1, 0]
    assert np.isclose(rows[0].x1, (1 - 0.8611363115940526) / 2)
    four = [Marginal("line", 1, 7, "DiscreteUniform"), Marginal("size", 1, 50, "DiscreteUniform"),
            Marginal("month", 1, 12, "DiscreteUniform"), Marginal("nation", 0, 24, "DiscreteUniform")]
    assert design.tensor_design(campaign(spark, four), four, 3).count() == 256


def test_pce_golden(spark):
    c = uq.pce_coefficients(golden(spark), MS, 3)
    m = uq.pce_moments(c, MS, 3).first()
    assert np.allclose([m["mean"], m["var"]], [5.5, 2.861111], atol=1e-6)
    first = {r.param: r.sobol for r in uq.pce_sobol(c, MS, 3, "first").collect()}
    total = {r.param: r.sobol for r in uq.pce_sobol(c, MS, 3, "total").collect()}
    second = uq.pce_sobol(c, MS, 3, "second").collect()
    assert np.allclose([first["x1"], first["x2"]], [0.262136, 0.728155], atol=1e-6)
    assert np.allclose([total["x1"], total["x2"]], [0.271845, 0.737864], atol=1e-6)
    assert len(second) == 1 and np.isclose(second[0].sobol, 0.009709, atol=1e-6)
    assert np.isclose(sum(first.values()) + second[0].sobol, 1)


def test_sc_golden(spark):
    g = golden(spark)
    m = uq.weighted_moments(g).first()
    assert np.allclose([m["mean"], m["var"]], [5.5, 2.861111], atol=1e-6)
    first = {r.param: r.sobol for r in uq.sc_first_order(g, ["x1", "x2"]).collect()}
    assert np.allclose([first["x1"], first["x2"]], [0.262136, 0.728155], atol=1e-6)
    assert uq.missing_nodes(g.filter("run_id > 1"), 16).first().n_missing == 2


def test_many_terms_take_the_exploded_path(spark, monkeypatch):
    direct = uq.pce_coefficients(golden(spark), MS, 3).first().coefs
    monkeypatch.setattr(uq, "MAX_SUMS", 3)
    assert np.allclose(uq.pce_coefficients(golden(spark), MS, 3).first().coefs, direct)


def test_evaluate(spark):
    c = uq.pce_coefficients(golden(spark), MS, 3)
    new = design.random_design(spark.range(20).withColumnRenamed("id", "sample_id"), "sample_id", MS, 5)
    new = new.withColumn("qoi", F.lit("f")).withColumn("t", F.lit(0)).withColumn("value", value())
    for r in uq.evaluate_pce(new, c, MS, 3).collect():
        assert np.isclose(r.prediction, r.value)


def test_interpolation_is_exact_for_the_golden_function(spark):
    nodes = [sorted({round(float(v), 12) for v in x}) for x in zip(*[(r.x1, r.x2) for r in golden(spark).collect()])]
    table = golden(spark).withColumns({n: F.round(n, 12) for n in ("x1", "x2")})
    new = design.random_design(spark.range(20).withColumnRenamed("id", "sample_id"), "sample_id", MS, 5)
    new = new.withColumn("qoi", F.lit("f")).withColumn("t", F.lit(0))
    got = uq.evaluate_sc(new, table, ["x1", "x2"], nodes).withColumn("value", value()).collect()
    assert len(got) == 20 and all(np.isclose(r.prediction, r.value) for r in got)
    cut = uq.evaluate_sc(new, table.filter(F.col("x1") != nodes[0][0]), ["x1", "x2"], nodes)
    assert {r.prediction for r in cut.collect()} == {None}


def test_constant_output_has_zero_indices(spark):
    g = golden(spark).withColumn("value", F.lit(2.0))
    c = uq.pce_coefficients(g, MS, 3).withColumn("coefs", F.transform("coefs", lambda v: F.round(v, 9)))
    assert {r.sobol for r in uq.pce_sobol(c, MS, 3, "first").collect()} == {0.0}


def test_sparse_grid_integrates_exactly(spark):
    for growth in (False, True):
        rows = design.sparse_design(campaign(spark), MS, 3, growth).collect()
        w = np.array([r.weight for r in rows])
        x, y = np.array([r.x1 for r in rows]), np.array([r.x2 for r in rows])
        assert np.isclose(w.sum(), 1) and np.isclose((w * x * y).sum(), 1.0)
        assert np.isclose((w * x**2).sum(), 1 / 3) and np.isclose((w * y**3).sum(), 10)


def test_sparse_nodes_merge_whatever_the_ranges(spark):
    wide = [Marginal("x", 900, 100_000), Marginal("y", 1e5, 1e7)]
    tiny = [Marginal("x", 1e-14, 9e-14), Marginal("y", 1e-14, 9e-14)]
    for ms in (wide, tiny):
        for level, growth in ((7, False), (9, False), (4, True)):
            rows = design.sparse_design(design.campaign_row(spark, ms), ms, level, growth).collect()
            assert len(rows) == len(design.sparse_nodes(MS, level, growth)) == len({(r.x, r.y) for r in rows})
            assert np.isclose(sum(r.weight for r in rows), 1)
    assert len(design.sparse_nodes(wide, 7)) == 137 and len(design.sparse_nodes(wide, 9)) == 281


def test_large_grid_is_made_in_many_tasks(spark, many_partitions):
    ms = [Marginal(f"x{i}", 0, 1) for i in range(8)]
    runs = design.tensor_design(design.campaign_row(spark, ms), ms, 3).select("run_id", F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in runs.groupBy("p").count().collect()]
    assert sum(sizes) == 4**8 and max(sizes) < 4**8 / 2
    assert runs.select("run_id").distinct().count() == 4**8


def test_sobol_beyond_the_published_dimensions_and_indices(spark):
    cols = [design.sobol_point(F.col("id"), d).alias(f"d{d}") for d in (12, 19, 25)]
    rows = np.array([list(r) for r in spark.range(256).select(*cols).collect()])
    for d in range(3):
        assert sorted((rows[:, d] * 256).astype(int)) == list(range(256))
    far = spark.createDataFrame([(5,), (5 + 2**32,)], "id long").select(design.sobol_point(F.col("id"), 3).alias("u")).collect()
    assert far[0].u != far[1].u
    with pytest.raises(Exception, match="beyond the Sobol sequence"):
        spark.createDataFrame([(2**52,)], "id long").select(design.sobol_point(F.col("id"), 0)).collect()
    ten = [Marginal(f"p{i}", 0, 1) for i in range(10)]
    assert design.quasi_random_design(spark.range(8).withColumnRenamed("id", "base"), "base", ten).count() == 96


def test_random_design_and_fresh_sample(spark):
    ms = [Marginal("a", 1, 6, "DiscreteUniform"), Marginal("b", -1.0, 1.0)]
    r = design.random_design(spark.range(3000).withColumnRenamed("id", "run_id"), "run_id", ms, 1)
    a = r.groupBy("a").count().orderBy("a").collect()
    assert [x.a for x in a] == [1, 2, 3, 4, 5, 6] and min(x["count"] for x in a) > 400
    fresh = design.fresh_sample(r.limit(7), ms, 2)
    assert fresh.count() == 700 and fresh.select("sample_id").distinct().count() == 700
    assert fresh.filter(~F.col("b").between(-1, 1)).isEmpty()


def test_sobol_points_stratify_every_dimension(spark):
    cols = [design.sobol_point(F.col("id"), d).alias(f"d{d}") for d in range(12)]
    rows = np.array([list(r) for r in spark.range(64).select(*cols).collect()])
    assert np.allclose(rows[1], 0.5)
    assert np.allclose(sorted(rows[2, :2]), [0.25, 0.75])
    for d in range(12):
        assert sorted((rows[:, d] * 64).astype(int)) == list(range(64))
    # Two dimensions: every elementary box of volume 1/64 holds one point.
    for a in range(7):
        boxes = {(int(x * 2**a), int(y * 2 ** (6 - a))) for x, y in rows[:, :2]}
        assert len(boxes) == 64


def test_qmc_indices(spark):
    bases = spark.range(1024).withColumnRenamed("id", "base")
    runs = design.quasi_random_design(bases, "base", MS)
    assert runs.count() == 1024 * 4 and runs.select("run_id").distinct().count() == 4096
    out = runs.select("base", "block", F.lit("f").alias("qoi"), F.lit(0).alias("t"), value().alias("value"))
    r = {x.param: x for x in uq.qmc_sobol(out, ["x1", "x2"]).collect()}
    assert np.isclose(r["x1"]["mean"], 5.5, atol=0.01) and np.isclose(r["x1"]["var"], 2.861111, atol=0.03)
    assert np.isclose(r["x1"].sobol_total, 0.271845, atol=0.01) and np.isclose(r["x2"].sobol_total, 0.737864, atol=0.01)
    assert np.isclose(r["x1"].sobol_first, 0.262136, atol=0.03) and np.isclose(r["x2"].sobol_first, 0.728155, atol=0.03)


def test_qmc_indices_use_complete_bases_only(spark):
    bases = spark.range(1024).withColumnRenamed("id", "base")
    runs = design.quasi_random_design(bases, "base", MS)
    out = runs.select("base", "block", F.lit("f").alias("qoi"), F.lit(0).alias("t"), value().alias("value"))
    lost = (F.col("block") == "AB_x1") & (F.pmod(F.xxhash64("base"), F.lit(2)) == 1)
    r = {x.param: x for x in uq.qmc_sobol(out.filter(~lost & (F.col("base") < 1000)), ["x1", "x2"], 1024).collect()}
    n = bases.filter("base < 1000 AND pmod(xxhash64(base), 2) = 0").count()
    assert r["x1"].n_bases == n and r["x1"].n_incomplete == 1024 - n
    assert np.isclose(r["x1"].sobol_first, 0.262136, atol=0.2) and np.isclose(r["x2"].sobol_total, 0.737864, atol=0.1)
    none = uq.qmc_sobol(out.filter(F.col("block") == "A"), ["x1", "x2"]).collect()
    assert {(x.n_bases, x.n_incomplete, x.sobol_first) for x in none} == {(0, 1024, None)}


def test_random_design_has_no_sobol(spark):
    with pytest.raises(uq.NoSobolAnalysis):
        uq.sobol_indices(golden(spark), MS, "random")
    assert set(uq.analyse(golden(spark), MS, "random")) == {"moments"}
    assert set(uq.analyse(golden(spark), MS, "pce")) == {"moments", "sobol_first", "sobol_total", "sobol_second"}


def test_describe_and_histogram(spark):
    v = np.random.default_rng(0).normal(size=501)
    df = spark.createDataFrame([("q", 0, float(x)) for x in v], "qoi string, t int, value double").repartition(4)
    r = uq.describe(df).first()
    assert np.allclose([r["mean"], r["var"], r["p10"], r["p90"]], [v.mean(), v.var(), *np.quantile(v, [0.1, 0.9])])
    h = uq.histogram(df).collect()
    expect, _ = np.histogram(v, 50, density=True)
    got = np.zeros(50)
    for x in h:
        got[x.bin] = x.density
    assert np.allclose(got, expect)


def test_collate_split_scale_rank(spark):
    wide = spark.createDataFrame([(r, t, float(r + t), float(r * t)) for r in range(10) for t in range(2)], "run_id long, t int, u double, w double")
    long = collate.collate(wide, ["run_id", "t"], ["u", "w"])
    assert long.count() == 40
    runs = wide.select("run_id").distinct()
    split = {r.run_id: r.split for r in collate.train_test_split(runs).collect()}
    assert [r for r in sorted(split) if split[r] == "test"] == [8, 9]
    vectors = {(r.run_id, r.qoi): r.target for r in collate.run_vectors(long).collect()}
    assert vectors[3, "u"] == [3.0, 4.0]
    total = collate.scale_targets(long).groupBy("qoi").agg(F.sum(F.col("value") ** 2).alias("s")).collect()
    assert np.allclose([r.s for r in total], 1)
    s = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 3.0), ("q2", "a", 2.0), ("q2", "b", 0.0)], "qoi string, param string, sensitivity double")
    ranked = collate.total_sensitivity(s).orderBy("rank").collect()
    assert [(r.param, r.sensitivity) for r in ranked] == [("a", 1.5), ("b", 1.5)]
    scaled = {r.param: r.sensitivity for r in collate.min_max_scaled(s.filter("qoi = 'q1'"), ["qoi"]).collect()}
    assert scaled == {"a": 0.0, "b": 1.0}


def test_sc_total_and_second_order_golden(spark):
    g = golden(spark)
    total = {r.param: r.sobol for r in uq.sc_sobol(g, ["x1", "x2"], "total").collect()}
    assert np.allclose([total["x1"], total["x2"]], [0.271845, 0.737864], atol=1e-6)
    second = uq.sc_sobol(g, ["x1", "x2"], "second", designed=16).first()
    assert (second.param, second.param2, second.n_missing) == ("x1", "x2", 0)
    assert np.isclose(second.sobol, 0.009709, atol=1e-6)
    first = {r.param: r.sobol for r in uq.sc_sobol(g, ["x1", "x2"], "first").collect()}
    assert np.allclose([first["x1"], first["x2"]], [0.262136, 0.728155], atol=1e-6)
    tables = uq.analyse(g, MS, "sc")
    assert set(tables) == {"moments", "sobol_first", "sobol_total", "sobol_second"}
    lost = g.filter("run_id <> 5")
    assert uq.sc_sobol(lost, ["x1", "x2"], "total", designed=16).first().n_missing == 1


def test_sc_indices_of_three_parameters_add_up(spark):
    """f = x1 x2 + x3: total of each parameter from the exact variances."""
    ms = [Marginal(n, -1.0, 1.0) for n in ("x1", "x2", "x3")]
    runs = design.tensor_design(design.campaign_row(spark, ms), ms, 2)
    g = runs.select("x1", "x2", "x3", "weight", F.lit("f").alias("qoi"), F.lit(0).alias("t"),
                    (F.col("x1") * F.col("x2") + F.col("x3")).alias("value"))
    names = [m.name for m in ms]
    v12, v3 = 1 / 9, 1 / 3
    total = {r.param: r.sobol for r in uq.sc_sobol(g, names, "total").collect()}
    assert np.allclose([total[n] for n in names], [v12 / (v12 + v3)] * 2 + [v3 / (v12 + v3)])
    second = {(r.param, r.param2): r.sobol for r in uq.sc_sobol(g, names, "second").collect()}
    assert np.allclose([second["x1", "x2"], second["x1", "x3"], second["x2", "x3"]], [v12 / (v12 + v3), 0, 0], atol=1e-12)
    flat = uq.sc_sobol(g.withColumn("value", F.lit(1.0)), names, "total").collect()
    assert {r.sobol for r in flat} == {0.0}


def test_weighted_statistics(spark):
    rng = np.random.default_rng(4)
    rows = [("q", t, float(rng.integers(0, 40)), float(w)) for t in range(2) for w in rng.normal(0.6, 1.0, 500)]
    rows += [("one", 0, 3.0, -2.0), ("zero", 0, 1.0, 0.0), ("zero", 0, 5.0, 2.0)]
    got = {(r.qoi, r.t): r for r in uq.weighted_describe(
        spark.createDataFrame(rows, "qoi string, t int, value double, weight double").repartition(7)).collect()}
    for key, r in got.items():
        own = sorted((v, w) for q, t, v, w in rows if (q, t) == key)
        v, w = np.array(own).T
        mean = (v * w).sum() / w.sum()
        assert np.allclose([r["mean"], r["var"], r["min"], r["max"]], [mean, (w * (v - mean) ** 2).sum() / w.sum(), v.min(), v.max()])
        for p, name in ((0.1, "p10"), (0.9, "p90")):
            sums = [(x, w[v <= x].sum()) for x in np.unique(v[w != 0])]
            assert r[name] == next((x for x, s in sums if s >= p * w.sum() - 1e-9), None)
    assert got["one", 0].p10 is None or got["one", 0].p10 == 3.0
    assert got["zero", 0].p90 == 5.0 and got["zero", 0]["min"] == 1.0


def test_second_order_blocks_find_the_interaction(spark):
    ms = [Marginal(n, -1.0, 1.0) for n in ("x1", "x2", "x3")]
    bases = spark.range(4096).withColumnRenamed("id", "base")
    runs = design.quasi_random_design(bases, "base", ms, second_order=True)
    assert runs.count() == 4096 * 8 and runs.select("run_id").distinct().count() == 4096 * 8
    one = {r.block: r for r in runs.filter("base = 7").collect()}
    assert one["BA_x2"].x2 == one["A"].x2 and one["BA_x2"].x1 == one["B"].x1 and one["AB_x2"].x1 == one["A"].x1
    outputs = runs.select("base", "block", F.lit("f").alias("qoi"), F.lit(0).alias("t"),
                          (F.col("x1") * F.col("x2") + F.col("x3")).alias("value"))
    names = [m.name for m in ms]
    got = {(r.param, r.param2): r.sobol_second for r in uq.qmc_second_order(outputs, names).collect()}
    assert np.allclose([got["x1", "x2"], got["x1", "x3"], got["x2", "x3"]], [0.25, 0, 0], atol=0.03)
    short = uq.qmc_second_order(outputs.filter("NOT (base < 96 AND block = 'BA_x1')"), names, 5000).first()
    assert (short.n_bases, short.n_incomplete) == (4000, 1000)


def test_qmc_outputs_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    """The customers are one small file, and the values of all their runs must not be gathered by one task."""
    monkeypatch.setattr(uq_queries, "TASK_BASES", 10, raising=False)
    spark.range(200).coalesce(1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [(0.01 * i, 0.01 * j, 1, 5.0 + i, 2.0 + j) for i in range(11) for j in range(9)]
    line = "l_discount double, l_tax double, l_linenumber long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = uq_queries.qmc_outputs(spark, str(tmp_path))
    sizes = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == 200 * 4 * 2 and len(sizes) >= 18
    assert {r.n_bases for r in uq_queries.qmc_second(spark, str(tmp_path)).collect()} == {200}
