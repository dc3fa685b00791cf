"""Tables the queries run on, derived from the star schema, and the query registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.polynomials import Marginal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def comparable(df: DataFrame, doubles: Sequence[str], digits: int) -> DataFrame:
    """Integers as long; the named doubles rounded, without negative zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in doubles:
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, query: Query, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6) -> None:
    """Add a query, and the SQL that must give the same rows."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: comparable(query(spark, sf_dir), doubles, digits)
    if sql is not None:
        swap = ", ".join(f'round("{d}", {digits}) + 0.0::DOUBLE AS "{d}"' for d in doubles)
        SQL[name] = f"SELECT * REPLACE ({swap}) FROM (\n{sql}\n)" if swap else sql


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the campaign on lineitem: a full grid of discount x tax ------------------------

DISCOUNT = Marginal("discount", 0, 10, "DiscreteUniform")
TAX = Marginal("tax", 0, 8, "DiscreteUniform")
GRID = [DISCOUNT, TAX]
NODES = DISCOUNT.support * TAX.support


def percent(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one observation of a run: (discount, tax, run_id, t, price, quantity)."""
    line = load(spark, sf_dir, "lineitem")
    return line.select(
        percent("l_discount").alias("discount"),
        percent("l_tax").alias("tax"),
        (percent("l_discount") * TAX.support + percent("l_tax")).alias("run_id"),
        (F.col("l_linenumber") - 1).cast("long").alias("t"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )


def grid_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output row per run and time: mean price and quantity."""
    return grid_rows(spark, sf_dir).groupBy("discount", "tax", "run_id", "t").agg(
        F.avg("price").alias("price"), F.avg("quantity").alias("quantity")
    )


def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run table: (run_id, discount, tax, weight)."""
    rows = grid_rows(spark, sf_dir).groupBy("run_id", "discount", "tax").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("run_id", "discount", "tax", F.lit(1.0 / NODES).alias("weight"))


def collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.collate import collate

    keys = ["run_id", "discount", "tax", "t"]
    long = collate(grid_outputs(spark, sf_dir), keys, ["price", "quantity"])
    return long.withColumn("weight", F.lit(1.0 / NODES))


GRID_SQL = """
cells AS (
  SELECT CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax,
         CAST(l_linenumber - 1 AS BIGINT) AS t, avg(l_extendedprice) AS price, avg(l_quantity) AS quantity
  FROM lineitem GROUP BY ALL),
collated AS (
  SELECT discount * 9 + tax AS run_id, discount, tax, t, 'price' AS qoi, price AS value FROM cells
  UNION ALL
  SELECT discount * 9 + tax, discount, tax, t, 'quantity', quantity FROM cells)
"""

OBSERVED_SQL = """
observed AS (
  SELECT CAST(round(l_discount * 100) AS BIGINT) AS discount, CAST(round(l_tax * 100) AS BIGINT) AS tax,
         CAST(l_linenumber - 1 AS BIGINT) AS t, 'price' AS qoi, l_extendedprice AS value FROM lineitem
  UNION ALL
  SELECT CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
         CAST(l_linenumber - 1 AS BIGINT), 'quantity', l_quantity FROM lineitem)
"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item and QoI as one value: the long form of ``grid_rows``."""
    from ..operators.collate import collate

    return collate(grid_rows(spark, sf_dir), ["run_id", "discount", "tax", "t"], ["price", "quantity"])


# --- line items as macro and nano series --------------------------------------------

# Which line item expression stands for which stress component.
STRESS_SQL = {
    "stress_00": "sqrt(l_quantity)",
    "stress_01": "sqrt(l_extendedprice)",
    "stress_02": "sqrt(l_discount)",
    "stress_11": "sqrt(l_tax)",
    "stress_12": "sqrt(l_quantity * l_tax)",
    "stress_22": "sqrt(l_extendedprice * l_discount)",
}
STRESS_LIST = ", ".join(f"{e} AS {n}" for n, e in STRESS_SQL.items())
STRESS_MEANS = ", ".join(f"avg({n}) AS {n}" for n in STRESS_SQL)
MONTH_SQL = "(year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1"


def stress_columns() -> list[Column]:
    return [F.expr(e).alias(n) for n, e in STRESS_SQL.items()]


def macro_rows(spark: SparkSession, sf_dir: str, status: str | None = None, step: str = MONTH_SQL) -> DataFrame:
    """Line items as macro rows: run = supplier, point = line number, step = month."""
    line = load(spark, sf_dir, "lineitem")
    if status is not None:
        line = line.filter(F.col("l_linestatus") == status)
    return line.select(
        F.col("l_suppkey").alias("run_id"), F.expr(step).cast("int").alias("timestep"),
        F.col("l_linenumber").alias("qpid"), *stress_columns(),
    )


def nano_rows(spark: SparkSession, sf_dir: str, status: str | None) -> DataFrame:
    """One row per supplier, line number and year: the series of a point of a run."""
    rows = macro_rows(spark, sf_dir, status, "year(l_shipdate)")
    return rows.groupBy("run_id", "qpid", F.col("timestep").alias("time_id")).agg(
        *[F.avg(c).alias(c) for c in schemas.STRESS]
    )


def supplier_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, step, six components): a supplier's mean line item of each month with sales."""
    from ..operators.prep import block_mean

    means = block_mean(macro_rows(spark, sf_dir), ["run_id"], "timestep", schemas.STRESS)
    return means.select(
        F.col("run_id").alias("cell"), F.col("t").alias("step"),
        *[F.col(s).alias(n) for s, n in zip(schemas.STRESS, schemas.STRAIN)],
    )


HISTORY_SQL = f"""
months AS (
  SELECT l_suppkey AS cell, {MONTH_SQL} AS m, {STRESS_LIST} FROM lineitem),
history AS (
  SELECT cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY m) - 1 AS BIGINT) AS step,
         {", ".join(f"avg({s}) AS {n}" for s, n in zip(schemas.STRESS, schemas.STRAIN))}
  FROM months GROUP BY cell, m)
"""
