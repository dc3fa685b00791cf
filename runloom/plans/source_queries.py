"""Round trips through campaign files: tables are written in the file layout, then scanned.

Files go to a fresh folder below the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.workspace import materialise, new_folder
from ..operators import prep, uq
from ..sources import files, sinks
from .prep_queries import BOTH, PREPARED_SQL, prepared_outputs
from .tables import (
    GRID_SQL, MONTH_SQL, STRESS_LIST, STRESS_SQL, collated, load, register, stress_columns,
)

S = schemas.STRESS


def _write_csv(df: DataFrame, label: str, by: str) -> str:
    path = new_folder(df.sparkSession, label)
    df.write.partitionBy(by).option("header", True).csv(path)
    return path


def boundary_force_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("run_"), F.ascii("o_orderstatus")).alias("dir"),
        F.col("o_orderkey").cast("int").alias("timestep"), (F.col("o_custkey") * 5.0e-7).alias("time"),
        F.col("o_totalprice").alias("resulting_force"),
    )
    return files.boundary_force(spark, _write_csv(orders, "force", "dir") + "/dir=*", r"run_(\d+)")


register(
    "boundary_force_scan",
    boundary_force_scan,
    """SELECT o_orderkey AS timestep, o_custkey * 5.0e-7::DOUBLE AS time, o_totalprice AS resulting_force,
              CAST(ascii(o_orderstatus) AS BIGINT) AS run_id FROM orders""",
    ["time"], 9,
)


def macro_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the 24 columns of a macro log, scanned and averaged per run and step."""
    step = F.expr(MONTH_SQL).cast("int")
    values = dict(zip(S, stress_columns()))
    strain = [(F.col("l_tax") + i).alias(n) for i, n in enumerate([*schemas.STRAIN, *schemas.UPDATED_STRAIN])]
    rows = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("run_"), "l_suppkey", F.lit(".csv")).alias("file"), step.alias("timestep"), (step * 5.0e-7).alias("time"),
        F.col("l_linenumber").alias("qpid"), F.floor(F.col("l_linenumber") / 2).cast("int").alias("cell"),
        (F.col("l_linenumber") % 2).alias("qpoint"), F.col("l_returnflag").alias("material"),
        *strain, *values.values(),
    )
    path = new_folder(spark, "macro")
    columns = rows.columns[1:]
    sinks.write_files(rows.select("file", F.to_csv(F.struct(*columns)).alias("line")), path, "file", "line", [], ",".join(columns))
    scanned = files.macro_history(spark, path, r"run_(\d+)")
    kept = prep.drop_columns(scanned, [c for c in schemas.MACRO_NON_STRESS if c != "timestep"])
    return prep.block_mean(kept, ["run_id"], "timestep", S)


register(
    "macro_history_scan",
    macro_history_scan,
    f"""WITH r AS (SELECT l_suppkey AS run_id, CAST({MONTH_SQL} AS BIGINT) AS timestep, {STRESS_LIST} FROM lineitem)
        SELECT run_id, timestep, {", ".join(f"avg({c}) AS {c}" for c in S)},
               CAST(row_number() OVER (PARTITION BY run_id ORDER BY timestep) - 1 AS BIGINT) AS t
        FROM r GROUP BY run_id, timestep""",
    S,
)


def nano_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as per-point files; point and replica are read back from the file path."""
    replica = F.when(F.col("l_linestatus") == "O", 1).otherwise(2)
    rows = load(spark, sf_dir, "lineitem").select(
        F.format_string("mddata_qpid%d_repl%d.csv", F.col("l_linenumber"), replica).alias("source"),
        F.col("l_linenumber").alias("qp_id"), F.col("l_returnflag").alias("material_id"),
        F.col("l_orderkey").cast("int").alias("time_id"), (F.lit(300.0) + F.col("l_discount")).alias("temperature"),
        F.lit(1e-4).alias("strain_rate"), F.lit("opls").alias("force_field"), replica.alias("replica_id"),
        *[(F.col("l_tax") + i).alias(n) for i, n in enumerate(schemas.STRAIN)], *stress_columns(),
    )
    scanned = files.nano_history(spark, _write_csv(rows, "nano", "source") + "/source=*")
    return scanned.groupBy("qpid", "repl", F.col("time_id").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("qp_id").alias("points"), *[F.sum(c).alias(c) for c in S]
    )


register(
    "nano_history_scan",
    nano_history_scan,
    f"""SELECT CAST(l_linenumber AS BIGINT) AS qpid, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END::BIGINT AS repl,
               l_orderkey AS t, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS points,
               {", ".join(f"sum({e}) AS {n}" for n, e in STRESS_SQL.items())}
        FROM lineitem GROUP BY ALL""",
    S,
)


def thermo_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log with one block per user and day; the 11th field of every row is summed."""
    events = load(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_id", F.col("value")
    )
    fields = ["user_id", "event_id", *["0"] * 8, "value"]
    data = events.select(
        "user_id", "day", F.lit(1).alias("kind"), "event_id",
        F.concat_ws("  ", *[F.lit(f) if f == "0" else F.col(f).cast("string") for f in fields]).alias("value"),
    )
    days = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    head = days.select("user_id", "day", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("event_id"),
                       F.lit("Step Temp E_pair E_mol TotEng Press Lx Ly Lz Pxx Pyy").alias("value"))
    tail = days.select("user_id", "day", F.lit(2).alias("kind"), F.lit(-1).cast("long").alias("event_id"),
                       F.concat(F.lit("Loop time of 1 for "), F.col("n"), F.lit(" steps\n\nother text")).alias("value"))
    path = new_folder(spark, "log")
    (
        data.unionByName(head).unionByName(tail)
        .repartitionByRange("user_id", "day").sortWithinPartitions("user_id", "day", "kind", "event_id")
        .select("value").write.text(path)
    )
    # The same steps in a log that was cut off before its block ended: it counts for nothing.
    broken = new_folder(spark, "broken-log")
    head.unionByName(data).repartitionByRange("user_id", "day").sortWithinPartitions("user_id", "day", "kind", "event_id").select(
        "value").write.text(broken)
    rows = files.block_rows(files.numbered_lines(spark, [path, broken]))
    parsed = rows.select(
        "file", "block", "row", F.get("tokens", F.lit(0)).try_cast("long").alias("user_id"),
        F.get("tokens", F.lit(10)).try_cast("double").alias("field"),
    ).filter("field IS NOT NULL")
    return parsed.groupBy("file", "block").agg(
        F.min("user_id").alias("user_id"), F.max("user_id").alias("user_to"), F.count(F.lit(1)).alias("n"),
        F.max("row").alias("last_row"), F.sum("field").alias("total"),
    ).drop("file", "block")


register(
    "thermo_log_scan",
    thermo_log_scan,
    """SELECT user_id, user_id AS user_to, count(*) AS n, count(*) - 1 AS last_row, sum(value) AS total
       FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    ["total"], 4,
)


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace tokens, first number and lines of every whole document."""
    docs = load(spark, sf_dir, "documents")
    tokens = F.filter(F.split("text", r"[ \t\n\f\r]+"), lambda w: w != "")
    return docs.select(
        "doc_id", F.size(tokens).alias("n_tokens"), F.get(tokens, F.lit(10)).alias("field_11"),
        F.regexp_extract("text", "([0-9]+)", 1).alias("first_number"), F.size(F.split("text", "\n")).alias("n_lines"),
    )


register(
    "text_tokens",
    text_tokens,
    r"""SELECT doc_id, len(w) AS n_tokens, w[11] AS field_11, regexp_extract(text, '([0-9]+)', 1) AS first_number,
               len(string_split(text, chr(10))) AS n_lines
        FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents)""",
)


def lineitem_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("cell1"), F.col("l_partkey").alias("cell2"), F.col("l_quantity").alias("dist"))


def similarity_edge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "edges")
    sinks.write_edges(lineitem_edges(spark, sf_dir), path)
    return files.similarity_edges(spark, path, "part-*").drop("file")


register(
    "similarity_edge_scan",
    similarity_edge_scan,
    "SELECT l_orderkey AS cell1, l_partkey AS cell2, l_quantity AS dist FROM lineitem",
    ["dist"],
)


def strain_history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's monthly means as one text file per cell, scanned with line numbers."""
    month = F.expr(MONTH_SQL)
    means = load(spark, sf_dir, "lineitem").select("l_suppkey", month.alias("m"), *stress_columns()).groupBy(
        "l_suppkey", "m"
    ).agg(*[F.avg(c).alias(c) for c in S])
    path = new_folder(spark, "strain")
    named = means.select(F.concat(F.lit("strain_"), "l_suppkey").alias("name"), "m", F.concat_ws(" ", *S).alias("value"))
    sinks.write_files(named, path, "name", "value", ["m"])
    return files.strain_histories(spark, path)


register(
    "strain_history_scan",
    strain_history_scan,
    f"""WITH m AS (SELECT l_suppkey AS cell, {MONTH_SQL} AS m, {STRESS_LIST} FROM lineitem)
        SELECT cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY m) - 1 AS BIGINT) AS step,
               {", ".join(f"avg({s}) AS {n}" for s, n in zip(S, schemas.STRAIN))} FROM m GROUP BY cell, m""",
    schemas.STRAIN,
)


def run_input_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per nation, written to its own folder and flattened."""
    customers = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last")
    )
    text = F.to_json(
        F.struct(
            F.struct(F.lit("branch").alias("kind"), F.col("n").alias("head count")).alias("office data"),
            F.struct(F.struct(F.col("last").alias("last number"), F.array(F.lit("k0")).alias("marks")).alias("people")).alias("book"),
        )
    )
    path = new_folder(spark, "inputs")
    customers.select(F.concat(F.lit("run_"), "c_nationkey").alias("dir"), text.alias("value")).repartition("dir").write.partitionBy(
        "dir"
    ).text(path)
    schema = (
        "`office data` struct<`kind`: string, `head count`: long>, "
        "`book` struct<`people`: struct<`last number`: long, `marks`: array<string>>>"
    )
    return files.run_inputs(spark, path + "/dir=*", schema, r"run_(\d+)/")


register(
    "run_input_scan",
    run_input_scan,
    """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS run_id, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY c_nationkey)
       SELECT run_id, 'office data/kind' AS path, 'branch' AS value FROM c
       UNION ALL SELECT run_id, 'office data/head count', CAST(n AS VARCHAR) FROM c
       UNION ALL SELECT run_id, 'book/people/last number', CAST(last AS VARCHAR) FROM c
       UNION ALL SELECT run_id, 'book/people/marks', '["k0"]' FROM c""",
)

# --- sinks -----------------------------------------------------------------------------


def result_csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "result")
    sinks.write_result_csv(prepared_outputs(spark, sf_dir), path, ["run_id", "t", *BOTH])
    schema = "run_id long, t long, " + ", ".join(f"{c} double" for c in BOTH)
    return spark.read.schema(schema).option("header", True).csv(path)


register("result_csv_sink", result_csv_sink, PREPARED_SQL, BOTH)


def campaign_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all order campaigns, run one again (status F), and read the whole store."""
    runs = load(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("campaign"), F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("value")
    )
    path = new_folder(spark, "store")
    sinks.write_campaign(runs, path)
    sinks.write_campaign(runs.filter("campaign = 'F'").withColumn("value", F.col("value") * 2), path)
    return spark.read.parquet(path)


register(
    "campaign_store",
    campaign_store,
    """SELECT o_orderstatus AS campaign, o_orderkey AS run_id,
              CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END AS value FROM orders""",
    ["value"], 2,
)


def analysis_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialise(collated(spark, sf_dir), "collated")
    moments = uq.weighted_moments(table)
    path = new_folder(spark, "analysis")
    sinks.write_analysis({"moments": moments, "sobol": uq.sc_first_order(table, ["discount", "tax"], moments)}, path)
    saved = spark.read.parquet(path + "/moments").select("qoi", "t", "mean")
    return saved.join(spark.read.parquet(path + "/sobol"), ["qoi", "t"])


register(
    "analysis_store",
    analysis_store,
    f"""WITH {GRID_SQL},
        moments AS (SELECT qoi, t, avg(value) AS mean, var_pop(value) AS var FROM collated GROUP BY qoi, t),
        cond AS (SELECT qoi, t, 'discount' AS param, avg(value) AS m, count(*) AS n FROM collated GROUP BY qoi, t, discount
                 UNION ALL SELECT qoi, t, 'tax', avg(value), count(*) FROM collated GROUP BY qoi, t, tax)
        SELECT qoi, t, max(mean) AS mean, param, sum(n * (m - mean) * (m - mean)) / sum(n) / max(var) AS sobol
        FROM cond JOIN moments USING (qoi, t) GROUP BY qoi, t, param""",
    ["mean", "sobol"], 4,
)


def mapping_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer copies from the first customer of its nation; written as text lines."""
    customers = load(spark, sf_dir, "customer")
    first = customers.groupBy("c_nationkey").agg(F.min("c_custkey").alias("rep"))
    mapping = customers.join(first, "c_nationkey").select(F.col("c_custkey").alias("gp"), "rep")
    path = new_folder(spark, "mapping")
    sinks.write_mapping(mapping, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


register(
    "mapping_sink",
    mapping_sink,
    """SELECT c_custkey || ' ' || min(c_custkey) OVER (PARTITION BY c_nationkey) AS line FROM customer""",
)
