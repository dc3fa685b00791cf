"""Queries on cleaning, block means, padding and joining of run outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ordinal import with_ordinal, with_spread_ordinal
from ..functions.vectors import linspace
from ..operators import prep
from .tables import (
    MONTH_SQL, STRESS_LIST, STRESS_MEANS, load, macro_rows, nano_rows, register,
)

S = schemas.STRESS


def column_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    joined = orders.join(
        customers.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    kept = prep.drop_columns(joined, ["c_custkey", "o_orderstatus"])
    named = prep.assign_header(kept, ["index", "cell", "force", "balance"])
    filled = prep.fill_zero(named, ["balance"])
    with_null = filled.withColumn("cell", F.when(F.col("force") > 1000, F.col("cell")))
    return prep.drop_nulls(with_null)


register(
    "column_cleanup",
    column_cleanup,
    """SELECT o_orderkey AS "index", o_custkey AS cell, o_totalprice AS force, coalesce(c_acctbal, 0.0) AS balance
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
       WHERE o_totalprice > 1000""",
)


def user_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return with_spread_ordinal(events, ["user_id"], ["event_id"], "position")


USER_POSITIONS = """
placed AS (
  SELECT user_id, event_id, event_type, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS position
  FROM events)
"""

register(
    "time_index",
    lambda spark, sf: user_positions(spark, sf).select("user_id", "event_id", F.col("position").alias("t")),
    f"WITH {USER_POSITIONS} SELECT user_id, event_id, position AS t FROM placed",
)


def math_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    x = F.col("l_quantity") - 25.0
    return line.groupBy("l_partkey").agg(
        F.sum(F.sqrt("l_extendedprice")).alias("roots"),
        F.sum(F.exp(-x * x / 200.0)).alias("kernel"),
        F.sum(F.pow(F.col("l_discount"), F.lit(2.0))).alias("squares"),
        F.sum(F.signum(x)).alias("signs"),
        F.sqrt(F.sum(F.col("l_quantity") * F.col("l_quantity"))).alias("norm"),
        F.sum(F.get(linspace(F.lit(0.0), F.col("l_quantity"), 5), F.lit(3))).alias("points"),
    )


register(
    "math_columns",
    math_columns,
    """SELECT l_partkey, sum(sqrt(l_extendedprice)) AS roots, sum(exp(-(l_quantity - 25) * (l_quantity - 25) / 200.0)) AS kernel,
              sum(pow(l_discount, 2)) AS squares, CAST(sum(sign(l_quantity - 25)) AS DOUBLE) AS signs,
              sqrt(sum(l_quantity * l_quantity)) AS norm, sum(0.75 * l_quantity) AS points
       FROM lineitem GROUP BY l_partkey""",
    ["roots", "kernel", "squares", "signs", "norm", "points"],
)


def series_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    long = line.groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("value"))
    # A run has few time steps: their numbers are read from the table.
    steps = [r[0] for r in line.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    wide = prep.series_to_matrix(long, ["l_suppkey"], "l_linenumber", "value", steps)
    return prep.assign_header(wide, ["l_suppkey", *[f"t{i}" for i in range(len(steps))]])


register(
    "series_matrix",
    series_matrix,
    "SELECT l_suppkey, " + ", ".join(
        f"sum(CASE WHEN l_linenumber = {i + 1} THEN l_quantity END) AS t{i}" for i in range(7)
    ) + " FROM lineitem GROUP BY l_suppkey",
    [f"t{i}" for i in range(7)], 4,
)

register(
    "block_means",
    lambda spark, sf: prep.block_mean(macro_rows(spark, sf), ["run_id"], "timestep", S),
    f"""WITH r AS (SELECT l_suppkey AS run_id, CAST({MONTH_SQL} AS BIGINT) AS timestep, {STRESS_LIST} FROM lineitem)
        SELECT run_id, timestep, {STRESS_MEANS},
               CAST(row_number() OVER (PARTITION BY run_id ORDER BY timestep) - 1 AS BIGINT) AS t
        FROM r GROUP BY run_id, timestep""",
    S, 6,
)


def positional_block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = user_positions(spark, sf_dir).select("user_id", "position", "value")
    out = None
    for mode in ("clean", "header_lost", "header_lost_skip_block"):
        part = prep.positional_block_mean(placed, ["user_id"], "position", ["value"], 16, mode)
        part = part.select(F.lit(mode).alias("mode"), "user_id", "t", "value")
        out = part if out is None else out.unionByName(part)
    return out


register(
    "positional_block_means",
    positional_block_means,
    f"""WITH {USER_POSITIONS}, n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
        SELECT 'clean' AS mode, user_id, position // 16 AS t, sum(value) / 16.0 AS value
        FROM placed JOIN n USING (user_id) WHERE position // 16 < n // 16 GROUP BY ALL
        UNION ALL
        SELECT 'header_lost', user_id, (position - 1) // 16 AS t, sum(value) / 16.0
        FROM placed JOIN n USING (user_id) WHERE position >= 1 AND (position - 1) // 16 < n // 16 GROUP BY ALL
        UNION ALL
        SELECT 'header_lost_skip_block', user_id, (position - 17) // 16 AS t, sum(value) / 16.0
        FROM placed JOIN n USING (user_id) WHERE position >= 17 AND (position - 17) // 16 < (n - 1) // 16 GROUP BY ALL""",
    ["value"],
)

register(
    "sampling_step_means",
    lambda spark, sf: prep.step_mean(user_positions(spark, sf), ["user_id"], "position", ["value"], 10),
    f"""WITH {USER_POSITIONS}
        SELECT user_id, position // 10 AS t, sum(value) / 10.0 AS value
        FROM placed GROUP BY ALL HAVING count(*) = 10""",
    ["value"],
)


def padded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type = run, user = point; the macro scale has the mean number of steps."""
    events = load(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    placed = with_spread_ordinal(events, ["event_type", "user_id"], ["event_id"], "position")
    steps = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(
        F.ceil(F.avg("n")).alias("steps")
    )
    return prep.front_pad(placed, steps, "event_type", "user_id", "position", ["value"], events)


register(
    "front_padded_points",
    padded_points,
    """WITH placed AS (
         SELECT event_type, user_id, value,
                CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS BIGINT) AS position,
                count(*) OVER (PARTITION BY event_type, user_id) AS n
         FROM events),
       points AS (SELECT DISTINCT event_type, user_id, n FROM placed),
       steps AS (SELECT event_type, ceil(avg(n)) AS steps FROM points GROUP BY event_type)
       SELECT event_type, user_id, CAST(position + CASE WHEN n < steps THEN 1 ELSE 0 END AS BIGINT) AS position, value
       FROM placed JOIN steps USING (event_type)
       UNION ALL
       SELECT event_type, user_id, CAST(0 AS BIGINT), 0.0 FROM points JOIN steps USING (event_type) WHERE n < steps""",
    ["value"],
)


def point_means(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nano = nano_rows(spark, sf_dir, None)
    placed = with_ordinal(nano, ["run_id", "qpid"], ["time_id"], "t")
    return prep.mean_across_points(placed, "run_id", "t", "qpid", S)


def point_cte(where: str = "true") -> str:
    return f"""
rows_ AS (SELECT l_suppkey AS run_id, CAST(l_linenumber AS BIGINT) AS qpid, year(l_shipdate) AS y, {STRESS_LIST}
          FROM lineitem WHERE {where}),
nano AS (SELECT run_id, qpid, CAST(row_number() OVER (PARTITION BY run_id, qpid ORDER BY y) - 1 AS BIGINT) AS t,
                {STRESS_MEANS} FROM rows_ GROUP BY run_id, qpid, y),
counts AS (SELECT run_id, qpid, count(*) AS n FROM nano GROUP BY ALL),
status AS (SELECT run_id, count(*) AS points, max(n) AS steps,
                  CASE WHEN min(n) = max(n) THEN 'ok' ELSE 'ragged' END AS status FROM counts GROUP BY run_id)
"""

register(
    "point_means",
    lambda spark, sf: point_means(spark, sf)[0],
    f"""WITH {point_cte()}
        SELECT run_id, t, {", ".join(f"sum({c}) / max(points) AS {c}" for c in S)}
        FROM nano JOIN status USING (run_id) WHERE status = 'ok' GROUP BY run_id, t""",
    S, 6,
)



def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier and every order is a designed run; only suppliers have outputs."""
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("run_id"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("run_id"))
    return prep.run_status(point_means(spark, sf_dir)[1], suppliers.union(orders), "run_id")


register(
    "run_status",
    run_statuses,
    f"""WITH {point_cte()}, designed AS (SELECT s_suppkey AS run_id FROM supplier UNION SELECT o_orderkey FROM orders)
        SELECT run_id, coalesce(points, 0) AS points, coalesce(steps, 0) AS steps, coalesce(status, 'missing') AS status
        FROM designed LEFT JOIN status USING (run_id)""",
)


def macro_nano_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(status: str, suffix: str) -> DataFrame:
        means = prep.block_mean(macro_rows(spark, sf_dir, status), ["run_id"], "timestep", S)
        return means.select("run_id", "t", *[F.col(c).alias(f"{c}_{suffix}") for c in S])

    return prep.join_scales(side("F", "macro"), side("O", "nano"), ["run_id", "t"])


def _side_sql(status: str, suffix: str) -> str:
    means = ", ".join(f"avg({c}) AS {c}_{suffix}" for c in S)
    return f"""(SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY m) - 1 AS t, {means}
                FROM (SELECT l_suppkey AS run_id, {MONTH_SQL} AS m, {STRESS_LIST} FROM lineitem
                      WHERE l_linestatus = '{status}') GROUP BY run_id, m)"""


BOTH = [*schemas.MACRO_STRESS, *schemas.NANO_STRESS]
register(
    "macro_nano_join",
    macro_nano_join,
    f"""SELECT run_id, CAST(t AS BIGINT) AS t, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in BOTH)}
        FROM {_side_sql("F", "macro")} RIGHT JOIN {_side_sql("O", "nano")} USING (run_id, t)""",
    BOTH, 6,
)


def prepared_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw macro and nano rows to the 12-column output of every complete run."""
    macro = macro_rows(spark, sf_dir, "F", "year(l_shipdate)")
    return prep.prepare_outputs(macro, nano_rows(spark, sf_dir, "O"))[0]


PREPARED_SQL = f"""
WITH macro_ AS (
  SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY y) - 1 AS BIGINT) AS t,
         {", ".join(f"avg({c}) AS {c}_macro" for c in S)}
  FROM (SELECT l_suppkey AS run_id, year(l_shipdate) AS y, {STRESS_LIST} FROM lineitem WHERE l_linestatus = 'F')
  GROUP BY run_id, y),
steps AS (SELECT run_id, count(*) AS steps FROM macro_ GROUP BY run_id),
{point_cte("l_linestatus = 'O'")},
lost AS (SELECT DISTINCT run_id FROM counts JOIN steps USING (run_id) WHERE n + 1 < steps.steps),
short AS (SELECT run_id, qpid FROM counts JOIN steps USING (run_id) WHERE n < steps),
padded AS (
  SELECT nano.run_id, nano.qpid, t + CASE WHEN short.qpid IS NULL THEN 0 ELSE 1 END AS t, {", ".join(S)}
  FROM nano LEFT JOIN short ON nano.run_id = short.run_id AND nano.qpid = short.qpid
  UNION ALL SELECT run_id, qpid, 0, {", ".join("0.0" for _ in S)} FROM short),
padded_counts AS (SELECT run_id, qpid, count(*) AS n FROM padded GROUP BY ALL),
good AS (SELECT run_id, count(*) AS points FROM padded_counts WHERE run_id NOT IN (SELECT run_id FROM lost)
         GROUP BY run_id HAVING min(n) = max(n)),
nano_ AS (SELECT run_id, t, {", ".join(f"sum({c}) / max(points) AS {c}_nano" for c in S)}
          FROM padded JOIN good USING (run_id) GROUP BY run_id, t)
SELECT run_id, CAST(t AS BIGINT) AS t, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in BOTH)}
FROM macro_ RIGHT JOIN nano_ USING (run_id, t)
"""
register("prepared_outputs", prepared_outputs, PREPARED_SQL, BOTH, 6)
