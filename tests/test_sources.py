import json
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom import schemas
from runloom.functions import workspace
from runloom.operators import prep
from runloom.plans import registry
from runloom.sources import files, params, sinks
from tests.oracle import differences

LOG = "preamble\nStep Temp PotEng\n0 1.0 -5\n10 2.0 -6\nLoop time 1\nother\nStep Temp PotEng\n20 3.0 -7\nLoop time 2\n\n"


def test_thermo_log_golden(spark, tmp_path):
    (tmp_path / "log.a").write_text(LOG)
    rows = files.thermo_log(spark, str(tmp_path)).orderBy("block", "row").collect()
    assert [(r.block, r.row, r.tokens) for r in rows] == [
        (0, 0, ["0", "1.0", "-5"]), (0, 1, ["10", "2.0", "-6"]), (1, 0, ["20", "3.0", "-7"])]
    f = prep.token_field(files.thermo_log(spark, str(tmp_path)), 3, "energy").orderBy("block", "row").collect()
    assert [r.energy for r in f] == [-5.0, -6.0, -7.0]
    f = prep.token_field(files.thermo_log(spark, str(tmp_path)), 3, "energy", skip_first=True)
    assert sorted(r.energy for r in f.collect()) == [-7.0, -6.0]


def test_block_that_is_not_closed_gives_nothing(spark, tmp_path):
    (tmp_path / "log").write_text("Step a\n1 2\nLoop\nStep a\n3 4\n5 6\n")
    rows = files.thermo_log(spark, str(tmp_path)).collect()
    assert [(r.block, r.row, r.tokens) for r in rows] == [(0, 0, ["1", "2"])]


def test_thermo_log_read_in_small_splits(spark, tmp_path):
    text = "".join(f"Step a b\n" + "".join(f"{b} {i}\n" for i in range(b % 5 + 1)) + "Loop\n" for b in range(60))
    (tmp_path / "log").write_text(text)
    (tmp_path / "log2").write_text("no block here\n" * 30)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.select("split").distinct().count() > 5
        got = sorted((r.block, r.row, int(r.tokens[0]), int(r.tokens[1])) for r in files.block_rows(lines).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(b, i, b, i) for b in range(60) for i in range(b % 5 + 1)]


def test_long_log_in_pieces(spark, tmp_path, monkeypatch):
    """Blocks and their rows go on from piece to piece; a line moves without the name of its file."""
    text = "".join("Step a b\n" + "".join(f"{b} {i}\n" for i in range(b % 23)) + "Loop\n\n" for b in range(40))
    (tmp_path / "a-log-with-a-long-name").write_text(text)
    (tmp_path / "log2").write_text("Step\n7 0\n7 1\nLoop\nStep\n" + "8 8\n" * 30)
    monkeypatch.setattr(files, "PIECE_LINES", 7)
    lines = files.numbered_lines(spark, str(tmp_path))
    numbers = [(r.n, r.last) for r in lines.groupBy("file_no").agg(F.count("line").alias("n"), F.max("line_no").alias("last")).collect()]
    assert sorted(numbers) == sorted((n, n - 1) for n in (len(text.splitlines()), 35))
    rows = files.block_rows(lines)
    got = sorted((r.file[-4:], r.block, r.row, *map(int, r.tokens)) for r in rows.collect())
    assert got == [("log2", 0, i, 7, i) for i in (0, 1)] + [("name", b, i, b, i) for b in range(40) for i in range(b % 23)]
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert all("file#" not in x.split("[", 1)[1] for x in plan.split("\n") if "Window [" in x and "line#" in x)


def test_nano_and_macro_scans(spark, tmp_path):
    header = ",".join(schemas.NANO_HISTORY.fieldNames())
    for run in (3, 4):
        d = tmp_path / f"run_{run}"
        d.mkdir()
        for q in (0, 1):
            body = "\n".join(f"{q},g0,{k},300.0,1e-4,opls,1," + ",".join(str(float(run + q + k)) for _ in range(12)) for k in range(2))
            (d / f"mddata_qpid{q}_repl1.csv").write_text(header + "\n" + body + "\n")
    df = files.nano_history(spark, str(tmp_path / "*" / "mddata_qpid*_repl1.csv"), run_pattern=r"run_(\d+)")
    got = sorted((r.run_id, r.qpid, r.repl, r.time_id, r.stress_22) for r in df.collect())
    assert got == sorted((run, q, 1, k, float(run + q + k)) for run in (3, 4) for q in (0, 1) for k in range(2))
    bad = tmp_path / "bad.csv"
    bad.write_text("timestep,time\n1,2.0\n")
    with pytest.raises(Exception):
        files.boundary_force(spark, str(bad)).collect()
    good = tmp_path / "good.csv"
    good.write_text("timestep,time,resulting_force\n1,0.5,2.0\n")
    assert tuple(files.boundary_force(spark, str(good)).first()) == (1, 0.5, 2.0)


def test_strain_histories_ignore_other_files(spark, tmp_path):
    for c in (7, 12):
        (tmp_path / f"strain_{c}").write_text("".join(" ".join(str(c + s + k / 10) for k in range(6)) + "\n" for s in range(3)))
    (tmp_path / "notes.txt").write_text("nothing")
    rows = files.strain_histories(spark, str(tmp_path)).orderBy("cell", "step").collect()
    assert [(r.cell, r.step) for r in rows] == [(c, s) for c in (7, 12) for s in range(3)]
    assert np.isclose(rows[0].strain_22, 7.5)


def test_write_files_one_for_each_name(spark, tmp_path):
    rows = [(f"f{i % 7}.txt", j, f"é {i} {j}" if (i, j) != (3, 4) else None) for i in range(7) for j in range(50)]
    df = spark.createDataFrame(rows, "file string, n int, line string").repartition(5)
    folder = tmp_path / "new" / "files"
    for header, first in ((None, []), ("a,b", ["a,b"])):
        sinks.write_files(df, str(folder), "file", "line", ["n"], header)
        assert sorted(p.name for p in folder.iterdir()) == [f"f{i}.txt" for i in range(7)]
        for i in range(7):
            expect = first + [f"é {i} {j}" if (i, j) != (3, 4) else "" for j in range(50)]
            assert (folder / f"f{i}.txt").read_text() == "\n".join(expect) + "\n"
    with pytest.raises(Exception, match="no file name"):
        sinks.write_files(df.withColumn("file", F.lit(None).cast("string")), str(folder), "file", "line", [])


@pytest.mark.parametrize("query,label,name", [
    ("strain_history_scan", "strain", r"strain_\d+"), ("macro_history_scan", "macro", r"run_\d+\.csv")])
def test_a_file_of_a_supplier_costs_no_folder(spark, tmp_path, query, label, name):
    """Null values pass, and the files of all suppliers lie in one folder, which is listed at once."""
    line = spark.createDataFrame(
        [(k, s, k % 3 + 1, 1.0 + k, 10.0 * k + s, 0.01 * (k % 5), 0.02, "R" if k % 2 else None, "O", f"1995-0{k % 3 + 1}-02 00:00:00")
         for s in range(40) for k in range(12)],
        "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
        "l_tax double, l_returnflag string, l_linestatus string, day string",
    ).withColumn("l_shipdate", F.to_timestamp("day")).withColumn("l_partkey", F.col("l_orderkey")).drop("day")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    before = set(Path(workspace.work_root(spark)).glob(f"{label}-*"))
    got = registry.QUERIES[query](spark, str(tmp_path)).toPandas()
    (folder,) = set(Path(workspace.work_root(spark)).glob(f"{label}-*")) - before
    paths = list(folder.iterdir())
    assert len(paths) == 40 and all(p.is_file() and re.fullmatch(name, p.name) for p in paths)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert len(got) == 120 and differences(got, con.execute(registry.SQL[query]).df()) == []


def test_similarity_edges_default_names(spark, tmp_path):
    (tmp_path / "last.1.similar_hist").write_text("1 2 0.5\n1 3 0.25\n")
    (tmp_path / "last.2.similar_hist").write_text("2 1 0.5\n\n")
    (tmp_path / "other.txt").write_text("9 9 9\n")
    df = files.similarity_edges(spark, str(tmp_path))
    assert sorted((r.cell1, r.cell2, r.dist) for r in df.collect()) == [(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5)]
    assert df.select("file").distinct().count() == 2


def test_run_inputs_flatten(spark, tmp_path):
    for r, temp in ((1, 100.0), (2, 200.0)):
        d = tmp_path / str(r)
        d.mkdir()
        (d / "inputs.json").write_text(json.dumps(
            {"problem type": {"class": "dogbone"}, "mesh": {"input": {"x length": 0.03}},
             "md": {"temperature": temp, "materials": ["g0"]}}, indent=2))
    got = {(r.run_id, r.path): r.value for r in files.run_inputs(spark, str(tmp_path / "*" / "inputs.json")).collect()}
    assert got["1", "problem type/class"] == "dogbone" and got["2", "md/temperature"] == "200.0"
    assert got["1", "mesh/input/x length"] == "0.03" and got["1", "md/materials"] == '["g0"]'


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "campaign string, run_id int, v double")
    store = str(tmp_path / "store")
    sinks.write_campaign(df, store)
    sinks.write_campaign(df.filter("campaign = 'b'").selectExpr("campaign", "run_id", "v * 10 AS v"), store)
    assert sorted((r.campaign, r.v) for r in spark.read.parquet(store).collect()) == [("a", 2.0), ("b", 30.0)]
    sinks.write_result_csv(df, str(tmp_path / "csv"), ["run_id", "v"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["run_id", "v"]
    m = spark.createDataFrame([(0, 1), (1, 1)], "gp long, rep long")
    sinks.write_mapping(m, str(tmp_path / "map"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "map")).collect()) == ["0 1", "1 1"]
    e = spark.createDataFrame([(1, 2, 0.5)], "cell1 long, cell2 long, dist double")
    sinks.write_edges(e, str(tmp_path / "edges"))
    back = files.similarity_edges(spark, str(tmp_path / "edges"), "part-*").first()
    assert (back.cell1, back.cell2, back.dist) == (1, 2, 0.5)
    sinks.write_analysis({"moments": df}, str(tmp_path / "analysis"))
    assert spark.read.parquet(str(tmp_path / "analysis" / "moments")).count() == 2


def test_parameter_table(spark):
    rows = [
        {"name": "temperature", "dtype": "float", "min": "0", "max": "600", "default": "350", "lower": 300, "upper": 550, "dist": "Uniform", "selected": True},
        {"name": "rate", "dtype": "float", "min": "0", "max": "1", "default": "0.5"},
    ]
    table = params.parameter_table(spark, rows)
    (m,) = params.marginals(table)
    assert (m.name, m.lower, m.upper, m.dist) == ("temperature", 300.0, 550.0, "Uniform")


def test_shared_folder_of_other_masters_must_be_named(spark):
    assert workspace.new_folder(spark, "x") != workspace.new_folder(spark, "x")
