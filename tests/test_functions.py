import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.functions import polynomials as poly
from runloom.functions.hashing import unit_hash
from runloom.functions.ordinal import with_ordinal, with_spread_ordinal
from runloom.functions.quantiles import exact_quantiles
from runloom.functions.spline import resample_histories
from runloom.functions.vectors import l2_distance, linspace
from runloom.functions import workspace


def natural_spline(y, num):
    n = len(y)
    x = np.linspace(0, n - 1, num)
    m = np.zeros(n)
    if n > 2:
        a = np.diag(np.full(n - 2, 4.0)) + np.diag(np.ones(n - 3), 1) + np.diag(np.ones(n - 3), -1)
        m[1:-1] = np.linalg.solve(a, 6 * (y[2:] - 2 * y[1:-1] + y[:-2]))
    k = np.minimum(x.astype(int), n - 2)
    t = x - k
    s = 1 - t
    return s * y[k] + t * y[k + 1] + ((s**3 - s) * m[k] + (t**3 - t) * m[k + 1]) / 6


def test_gauss_rule_order_three():
    nodes, weights = poly.gauss_rule(poly.Marginal("x", 0, 1), 3)
    assert np.allclose(nodes, [-0.861136, -0.339981, 0.339981, 0.861136], atol=1e-6)
    assert np.allclose(weights, [0.173927, 0.326073, 0.326073, 0.173927], atol=1e-6)


@pytest.mark.parametrize("dist,lower,upper", [("Uniform", 1.0, 3.0), ("DiscreteUniform", 1, 20), ("DiscreteUniform", 0, 8)])
def test_polynomials_are_orthonormal(dist, lower, upper):
    m = poly.Marginal("x", lower, upper, dist)
    if dist == "Uniform":
        z, w = poly.gauss_rule(m, 8)
    else:
        z = (np.arange(lower, upper + 1) - m.centre) / m.half
        w = np.full(len(z), 1 / len(z))
    p = np.stack([np.polyval(c[::-1], z) for c in poly.monomials(m, 4)])
    assert np.allclose((p * w) @ p.T, np.eye(5), atol=1e-10)


def test_discrete_rule_is_exact():
    m = poly.Marginal("x", 1, 20, "DiscreteUniform")
    z, w = poly.gauss_rule(m, 3)
    x = m.centre + m.half * z
    for k in range(8):
        assert np.isclose((w * x**k).sum(), np.mean(np.arange(1, 21.0) ** k), rtol=1e-10)


def test_gradient_of_basis():
    ms = [poly.Marginal("a", 0, 1), poly.Marginal("b", 1, 3)]
    x = np.random.default_rng(0).random((5, 2)) + [0, 1]
    _, grad = poly.basis_values(ms, 3, x)
    for i in range(2):
        h = np.zeros(2)
        h[i] = 1e-6
        up, _ = poly.basis_values(ms, 3, x + h)
        down, _ = poly.basis_values(ms, 3, x - h)
        assert np.allclose((up - down) / 2e-6, grad[:, i], atol=1e-6)


def test_unit_hash_does_not_depend_on_partitions(spark):
    one = spark.range(100).repartition(1).select("id", unit_hash(7, "p", "id").alias("u"))
    many = spark.range(100).repartition(7).select("id", unit_hash(7, "p", "id").alias("u"))
    a = {r.id: r.u for r in one.collect()}
    assert a == {r.id: r.u for r in many.collect()}
    digits = hashlib.md5(b"7:p:42").hexdigest()[:13]
    assert a[42] == int(digits, 16) / 2**52


@pytest.mark.parametrize("place", [with_ordinal, with_spread_ordinal])
def test_ordinal_matches_sorted_position(spark, place):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(o), i) for i, (k, o) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 90, 200)))]
    rows += [(None, 5.0, 900), (None, 4.0, 901)]
    df = spark.createDataFrame(rows, "k int, o double, i int").repartition(5)
    got = {r.i: r.ordinal for r in place(df, ["k"], ["o", "i"]).collect()}
    assert len(got) == 202
    for k in (0, 1, 2, None):
        expect = [i for _, i in sorted((o, i) for kk, o, i in rows if kk == k)]
        assert [got[i] for i in expect] == list(range(len(expect)))


@pytest.mark.parametrize("place", [with_ordinal, with_spread_ordinal])
@pytest.mark.parametrize("kind", ["string", "date", "double", "timestamp"])
def test_ordinal_of_any_type(spark, place, kind):
    days = spark.range(500).select("id", F.expr(f"cast(date_add(date '2020-01-01', int(id * 7 % 60)) as {'date' if kind == 'double' else kind})").alias("o"))
    df = days.withColumn("o", F.unix_date("o").cast("double")) if kind == "double" else days
    rows = place(df.repartition(7), [], ["o", "id"]).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.ordinal)] == [r.id for r in sorted(rows, key=lambda r: (r.o, r.id))]
    assert sorted(r.ordinal for r in rows) == list(range(500))


def test_spread_ordinal_splits_one_repeated_value(spark, many_partitions):
    df = spark.range(4000).select("id", F.lit(1).alias("k"), F.lit(2.0).alias("o"))
    placed = with_spread_ordinal(df, ["k"], ["o"]).withColumn("p", F.spark_partition_id())
    assert sorted(r.ordinal for r in placed.collect()) == list(range(4000))
    assert placed.groupBy("p").count().agg(F.max("count")).first()[0] < 2000


def test_spread_ordinal_counts_the_rows_of_groups_of_any_size(spark, many_partitions):
    """Groups inside a partition and over several ones, a null key; equal rows need no hash to be told apart."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") < 2990, 2).alias("k"), "id")
    placed = with_spread_ordinal(df.repartition(6), ["k"], ["id"], "at", "n")
    assert placed.columns == ["k", "id", "at", "n"]
    rows = placed.collect()
    for k in (1, 2, None):
        mine = sorted((r.id, r["at"], r.n) for r in rows if r.k == k)
        assert [(at, n) for _, at, n in mine] == [(i, len(mine)) for i in range(len(mine))]
    assert len(rows) == 3000


def test_salt_spreads_a_group_that_lies_in_one_partition(spark, many_partitions):
    from runloom.functions.joins import join_group_stats

    rows = spark.range(2000).select("id", F.lit(1).alias("k")).repartition(8, "k")
    stats = spark.createDataFrame([(1, 5)], "k int, s int")
    met = join_group_stats(rows, stats, ["k"]).withColumn("p", F.spark_partition_id())
    assert met.count() == 2000 and met.filter("s = 5").groupBy("p").count().agg(F.max("count")).first()[0] < 1500


@pytest.mark.parametrize("place", [with_ordinal, with_spread_ordinal])
def test_ordinal_of_one_group_with_an_outlier_and_nulls(spark, place):
    rng = np.random.default_rng(8)
    values = [float(v) for v in rng.permutation(300)] + [1e12, -1e12, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, o double").repartition(4)
    got = {r.i: r.ordinal for r in place(df, [], ["o", "i"]).collect()}
    # Rows without order value come first.
    placed = [i for i, v in sorted(enumerate(values), key=lambda p: (p[1] is not None, p[1] or 0.0))]
    assert [got[i] for i in placed] == list(range(len(values)))


def test_exact_quantiles_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(2)
    hot = np.concatenate([np.full(400, 3.0), rng.normal(0, 5, 601)])
    groups = {"hot": hot, "one": np.array([2.5]), "flat": np.full(9, 1.5), "few": np.array([1.0, 2.0, 4.0, 9.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}, bins=16)
    for r in out.collect():
        assert np.allclose([r.a, r.b, r.c], np.quantile(groups[r.k], [0.1, 0.5, 0.9]))
    assert out.count() == 4


def test_exact_quantiles_with_a_far_outlier(spark):
    v = np.append(np.random.default_rng(4).normal(size=5000), [1e12, -1e15])
    df = spark.createDataFrame([("k", float(x)) for x in v], "k string, v double")
    r = exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.9}).first()
    assert np.allclose([r.a, r.b], np.quantile(v, [0.1, 0.9]))


def test_spline_equals_dense_solution(spark):
    rng = np.random.default_rng(3)
    histories = {0: rng.normal(size=2), 1: rng.normal(size=3), 2: rng.normal(size=17), 3: rng.normal(size=300).cumsum(),
                 4: rng.normal(size=70)}
    rows = [(c, s, float(v), float(2 * v + 1)) for c, ys in histories.items() for s, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "cell long, step int, u double, w double").repartition(4)
    got = resample_histories(df, ["cell"], "step", ["u", "w"], 10).orderBy("cell", "point").collect()
    for c, ys in histories.items():
        mine = np.array([(r.u, r.w) for r in got if r.cell == c])
        expect = natural_spline(ys, 10)
        assert np.allclose(mine[:, 0], expect, atol=1e-10)
        assert np.allclose(mine[:, 1], 2 * expect + 1, atol=1e-10)
    assert {r.cell for r in resample_histories(df, ["cell"], "step", ["u"], 10, min_steps=50).collect()} == {3, 4}


def test_histories_of_one_length_share_their_knots(spark, monkeypatch):
    from runloom.functions import spline

    kept, write = [], spline.materialise
    monkeypatch.setattr(spline, "materialise", lambda df, label: kept.append(write(df, label)) or kept[-1])
    monkeypatch.setattr(spline, "PIECE", 4)
    rng = np.random.default_rng(5)
    ys = {c: rng.normal(size=9 if c % 2 else 30) for c in range(40)}
    df = spark.createDataFrame([(c, s, float(v)) for c, y in ys.items() for s, v in enumerate(y)], "cell long, step int, u double")
    got = resample_histories(df, ["cell"], "step", ["u"], 7).orderBy("cell", "point").collect()
    assert kept[0].count() == 9 + 30
    for c, y in ys.items():
        assert np.allclose([r.u for r in got if r.cell == c], natural_spline(y, 7), atol=1e-10)


def test_spline_rejects_gaps(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0)], "cell long, step int, u double")
    with pytest.raises(Exception, match="without gaps"):
        resample_histories(df, ["cell"], "step", ["u"], 4).collect()


def test_vectors(spark):
    r = spark.range(1).select(
        l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d"),
        linspace(F.lit(1.0), F.lit(2.0), 5).alias("x"),
    ).first()
    assert r.d == 5.0 and r.x == [1.0, 1.25, 1.5, 1.75, 2.0]


def test_workspace_uses_the_named_folder(spark):
    assert workspace.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = workspace.materialise(spark.range(5).withColumn("x", F.col("id") * 2), "twice")
    assert df.count() == 5 and workspace.work_root(spark) in df.inputFiles()[0]
