import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom import schemas
from runloom.operators import documents, prep

S = schemas.STRESS


@pytest.mark.parametrize(
    "mode,expect",
    [("clean", [8.5, 24.5, 40.5]), ("header_lost", [9.5, 25.5, 38.4375]), ("header_lost_skip_block", [25.5, 38.4375])],
)
def test_positional_block_mean_golden(spark, mode, expect):
    df = spark.range(48).select(F.lit(1).alias("run"), F.col("id").alias("pos"), (F.col("id") + 1.0).alias("v"))
    out = prep.positional_block_mean(df, ["run"], "pos", ["v"], 16, mode).orderBy("t").collect()
    assert [r.t for r in out] == list(range(len(expect)))
    assert np.allclose([r.v for r in out], expect)


def test_block_mean_by_key(spark):
    rows = [(r, 10 * s, p, float(100 * r + 10 * s + p)) for r in (1, 2) for s in (3, 1, 2) for p in range(4)]
    df = spark.createDataFrame(rows, "run_id int, timestep int, qpid int, v double").repartition(3)
    out = prep.block_mean(df, ["run_id"], "timestep", ["v"]).orderBy("run_id", "t").collect()
    assert [(r.run_id, r.t, r.v) for r in out] == [(r, s - 1, 100 * r + 10 * s + 1.5) for r in (1, 2) for s in (1, 2, 3)]


def test_front_pad_adds_one_zero_row_to_short_points(spark):
    rows = [(1, 0, 0, 5.0), (1, 0, 1, 6.0), (1, 1, 0, 7.0)]
    nano = spark.createDataFrame(rows, "run_id int, qpid int, position long, v double")
    steps = spark.createDataFrame([(1, 2)], "run_id int, steps long")
    out = prep.front_pad(nano, steps, "run_id", "qpid", "position", ["v"]).orderBy("qpid", "position").collect()
    assert [(r.qpid, r.position, r.v) for r in out] == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 0.0), (1, 1, 7.0)]


def test_step_mean_leaves_out_unfinished_block(spark):
    df = spark.range(7).select(F.lit(1).alias("p"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    out = prep.step_mean(df, ["p"], "pos", ["v"], 3).orderBy("t").collect()
    assert [(r.t, r.v) for r in out] == [(0, 1.0), (1, 4.0)]


def test_ragged_run_is_reported_and_others_kept(spark):
    rows = [(1, 0, 0, 2.0), (1, 0, 1, 4.0), (2, 0, 0, 2.0), (2, 0, 1, 4.0), (2, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "run_id int, t long, qpid int, v double")
    means, status = prep.mean_across_points(df, "run_id", "t", "qpid", ["v"])
    assert [(r.run_id, r.v) for r in means.collect()] == [(1, 3.0)]
    assert {r.run_id: r.status for r in status.collect()} == {1: "ok", 2: "ragged"}


def test_point_that_stays_short_makes_its_run_short(spark):
    v = [1.0] * 6
    macro = spark.createDataFrame([(r, s, 0, *v) for r in (1, 2) for s in range(6)], ["run_id", "timestep", "qpid", *S])
    nano = spark.createDataFrame([(1, 0, k, *v) for k in range(2)] + [(2, 0, k, *v) for k in range(5)], ["run_id", "qpid", "time_id", *S])
    wide, status = prep.prepare_outputs(macro, nano)
    assert {r.run_id: r.status for r in status.collect()} == {1: "short", 2: "ok"}
    assert {r.run_id for r in wide.collect()} == {2} and wide.count() == 6
    designed = spark.createDataFrame([(1,), (2,), (3,)], "run_id long")
    got = {r.run_id: (r.points, r.status) for r in prep.run_status(status, designed, "run_id").collect()}
    assert got == {1: (1, "short"), 2: (1, "ok"), 3: (0, "missing")}


def test_prepare_outputs_end_to_end(spark):
    rng = np.random.default_rng(0)
    points, steps, m = 4, 3, 2
    macro = [(r, s, p, *rng.normal(size=6).tolist()) for r in range(2) for s in range(steps) for p in range(points)]
    nano = []
    for r in range(2):
        for p in range(points):
            # Run 1 has 8 nano rows per point: one time step more than the macro scale.
            for k in range(steps * m + (2 if r else 0)):
                nano.append((r, p, k, *rng.normal(size=6).tolist()))
    mdf = spark.createDataFrame(macro, ["run_id", "timestep", "qpid", *S])
    ndf = spark.createDataFrame(nano, ["run_id", "qpid", "time_id", *S])
    wide, status = prep.prepare_outputs(mdf, ndf, sampling_steps=m)
    got = {(r.run_id, r.t): r for r in wide.collect()}
    assert {r.status for r in status.collect()} == {"ok"}
    assert len(got) == 7
    a_macro = np.array([x[3:] for x in macro if x[0] == 0 and x[1] == 1]).mean(axis=0)
    a_nano = np.array([x[3:] for x in nano if x[0] == 0 and x[2] in (2, 3)]).sum(axis=0) / m / points
    assert np.allclose([got[0, 1][c] for c in schemas.MACRO_STRESS], a_macro)
    assert np.allclose([got[0, 1][c] for c in schemas.NANO_STRESS], a_nano)
    assert [got[1, 3][c] for c in schemas.MACRO_STRESS] == [0.0] * 6


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 3.0, None)], "a int, b double, c double")
    assert prep.drop_columns(df, ["b"]).columns == ["a", "c"]
    with pytest.raises(ValueError):
        prep.drop_columns(df, ["nope"])
    assert prep.assign_header(df, ["x", "y", "z"]).columns == ["x", "y", "z"]
    assert [tuple(r) for r in prep.fill_zero(df).orderBy("a").collect()] == [(1, 0.0, 2.0), (2, 3.0, 0.0)]
    assert prep.drop_nulls(df).count() == 0 and prep.drop_nulls(df, ["b"]).count() == 1
    long = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "r int, t int, v double")
    m = prep.series_to_matrix(long, ["r"], "t", "v", [0, 1]).orderBy("r").collect()
    assert [tuple(x) for x in m] == [(1, 5.0, 6.0), (2, 7.0, None)]
    assert {r.r: r.v for r in prep.series_to_array(long, ["r"], "t", "v").collect()} == {1: [5.0, 6.0], 2: [7.0]}


def test_render_documents_golden(spark):
    runs = spark.createDataFrame([(0, 7)], "run_id int, n int")
    r = documents.render_documents(runs, "${n}.0e-4 ${n}0", ["n"]).first()
    assert r.document == "7.0e-4 70" and not r.unresolved
    assert documents.render_documents(runs, "${n} ${m}", ["n"]).first().unresolved


def test_defaults_and_violations(spark):
    specs = [
        {"name": "n", "dtype": "integer", "min": "0", "max": "30", "default": "10"},
        {"name": "x", "dtype": "float", "min": "0", "max": "1", "default": "0.5"},
    ]
    runs = spark.createDataFrame([(0, 2.0), (1, 0.25), (2, None)], "run_id int, x double")
    out = {r.run_id: r for r in documents.fill_defaults(runs, specs).collect()}
    assert out[0].violations == ["x"] and out[1].violations == [] and out[2].x == 0.5 and out[2].n == 10


def test_sweep_difference(spark):
    rows = [(r, "a/b", "same") for r in range(3)] + [(r, "md/temperature", str(100 * (r + 1))) for r in range(3)]
    entries = spark.createDataFrame(rows, "run_id int, path string, value string")
    assert [tuple(r) for r in documents.varying_paths(entries).collect()] == [("md/temperature", 3)]
    assert documents.sweep_difference(entries).count() == 3
    t = documents.sweep_table(entries, ["md/temperature"]).orderBy("run_id").collect()
    assert [r["md/temperature"] for r in t] == ["100", "200", "300"]
