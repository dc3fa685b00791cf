"""Queries on parameter tables, run documents and experimental designs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.polynomials import Marginal
from ..operators import design, documents
from ..sources import files, params
from .tables import load, register


def parameter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One parameter per part brand: range of sizes, default price, quoted as text."""
    part = load(spark, sf_dir, "part")
    return part.groupBy(F.col("p_brand").alias("name")).agg(
        F.lit("integer").alias("dtype"),
        F.min("p_size").cast("string").alias("min"),
        F.max("p_size").cast("string").alias("max"),
        F.min("p_retailprice").cast("string").alias("default"),
        (F.min("p_size") + 1).cast("string").alias("lower"),
        (F.max("p_size") - 1).cast("string").alias("upper"),
        F.lit("DiscreteUniform").alias("dist"),
        (F.count(F.lit(1)) % 2 == 0).alias("selected"),
    )


register(
    "parameter_table",
    lambda spark, sf: params.selected(params.typed(parameter_records(spark, sf))),
    """SELECT p_brand AS name, 'integer' AS dtype, min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max,
              min(p_retailprice) AS "default", (min(p_size) + 1)::DOUBLE AS lower, (max(p_size) - 1)::DOUBLE AS upper,
              'DiscreteUniform' AS dist, true AS selected
       FROM part GROUP BY p_brand HAVING count(*) % 2 = 0""",
    ["default"],
)

# A nested run document; ${name} is replaced by the run's value.
TEMPLATE = """{
  "parcel kind": {"state": "${status}", "fee share": ${rate}.0e-4},
  "due dates": {"first day": 1, "last day": ${steps}0},
  "crate": {"shape": {"form": "drum", "lid count": 2, "wall width": 0.25}},
  "delivery notes": {"season": ${season}, "labels": ["${priority}"]}
}"""
TEMPLATE_NAMES = ["status", "rate", "steps", "season", "priority"]
DOCUMENT_SCHEMA = (
    "`parcel kind` struct<`state`: string, `fee share`: double>, "
    "`due dates` struct<`first day`: long, `last day`: long>, "
    "`crate` struct<`shape`: struct<`form`: string, `lid count`: long, `wall width`: double>>, "
    "`delivery notes` struct<`season`: double, `labels`: array<string>>"
)


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    runs = orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"),
        (F.col("o_custkey") % 20 + 1).alias("rate"), F.month("o_orderdate").alias("steps"),
        F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("priority"),
    )
    return documents.render_documents(runs, TEMPLATE, TEMPLATE_NAMES)


def _rendered_sql() -> str:
    text = "'" + TEMPLATE.replace("'", "''") + "'"
    for n in TEMPLATE_NAMES:
        text = f"replace({text}, '${{{n}}}', CAST({n} AS VARCHAR))"
    return f"""runs AS (
      SELECT o_orderkey AS run_id, o_orderstatus AS status, o_custkey % 20 + 1 AS rate, month(o_orderdate) AS steps,
             year(o_orderdate) AS season, o_orderpriority AS priority FROM orders),
    rendered AS (SELECT run_id, {text} AS document FROM runs)"""


register(
    "rendered_documents",
    order_documents,
    f"WITH {_rendered_sql()} SELECT run_id, document, contains(document, '${{') AS unresolved FROM rendered",
)


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered documents as (run_id, path, value)."""
    docs = order_documents(spark, sf_dir)
    parsed = docs.select("run_id", F.from_json("document", DOCUMENT_SCHEMA).alias("d")).select("run_id", "d.*")
    return files.flatten_documents(parsed, "run_id")


# Numbers are compared as text with four decimals: engines print doubles differently.
ENTRIES_SQL = """entries AS (
      SELECT run_id, 'parcel kind/state' AS path, status AS value FROM runs
      UNION ALL SELECT run_id, 'parcel kind/fee share', CAST(rate AS VARCHAR) || 'e-4' FROM runs
      UNION ALL SELECT run_id, 'due dates/first day', '1' FROM runs
      UNION ALL SELECT run_id, 'due dates/last day', CAST(steps * 10 AS VARCHAR) FROM runs
      UNION ALL SELECT run_id, 'crate/shape/form', 'drum' FROM runs
      UNION ALL SELECT run_id, 'crate/shape/lid count', '2' FROM runs
      UNION ALL SELECT run_id, 'crate/shape/wall width', '0.25' FROM runs
      UNION ALL SELECT run_id, 'delivery notes/season', CAST(season AS VARCHAR) || '.0' FROM runs
      UNION ALL SELECT run_id, 'delivery notes/labels', '["' || priority || '"]' FROM runs)"""


def shown(entries: DataFrame) -> DataFrame:
    rate = F.col("path") == "parcel kind/fee share"
    text = F.concat(F.round(F.when(rate, F.col("value")).cast("double") * 1e4).cast("long").cast("string"), F.lit("e-4"))
    return entries.withColumn("value", F.when(rate, text).otherwise(F.col("value")))


register(
    "document_entries",
    lambda spark, sf: shown(order_entries(spark, sf)),
    f"WITH {_rendered_sql()}, {ENTRIES_SQL} SELECT * FROM entries",
)

register(
    "sweep_difference",
    lambda spark, sf: shown(documents.sweep_difference(order_entries(spark, sf))),
    f"""WITH {_rendered_sql()}, {ENTRIES_SQL},
        varying AS (SELECT path FROM entries GROUP BY path HAVING count(DISTINCT value) > 1)
        SELECT run_id, path, value FROM entries JOIN varying USING (path)""",
)

register(
    "varying_paths",
    lambda spark, sf: documents.varying_paths(order_entries(spark, sf)),
    f"""WITH {_rendered_sql()}, {ENTRIES_SQL}
        SELECT path, count(DISTINCT value) AS n_values FROM entries GROUP BY path HAVING count(DISTINCT value) > 1""",
)

SWEPT = ["due dates/last day", "delivery notes/season"]
register(
    "sweep_table",
    lambda spark, sf: documents.sweep_table(order_entries(spark, sf), SWEPT).toDF("run_id", "last_day", "season"),
    f"""WITH {_rendered_sql()} SELECT run_id, CAST(steps * 10 AS VARCHAR) AS last_day,
        CAST(season AS VARCHAR) || '.0' AS season FROM runs""",
)


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    docs = events.select(F.col("event_id").alias("run_id"), F.from_json("props", "k long").alias("props"))
    return files.flatten_documents(docs, "run_id")


register(
    "event_property_entries",
    event_entries,
    """SELECT event_id AS run_id, 'props/k' AS path, json_extract_string(props, '$.k') AS value FROM events
       WHERE json_extract_string(props, '$.k') IS NOT NULL""",
)

SPECS = [
    {"name": "size", "dtype": "integer", "min": "5", "max": "45", "default": "10"},
    {"name": "price", "dtype": "float", "min": "900.0", "max": "1900.0", "default": "1000.0"},
    {"name": "shelf", "dtype": "integer", "min": "0", "max": "90", "default": "12"},
]


def default_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    runs = part.select(
        F.col("p_partkey").alias("run_id"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_size")).alias("size"),
        F.col("p_retailprice").alias("price"),
    )
    out = documents.fill_defaults(runs, SPECS)
    return out.withColumn("violations", F.array_join("violations", ","))


register(
    "default_parameters",
    default_parameters,
    """WITH r AS (SELECT p_partkey AS run_id, CASE WHEN p_type <> 'ECONOMY' THEN p_size ELSE 10 END::BIGINT AS size,
                         p_retailprice AS price FROM part)
       SELECT run_id, size, price, CAST(12 AS BIGINT) AS shelf,
              concat_ws(',', CASE WHEN NOT size BETWEEN 5 AND 45 THEN 'size' END,
                        CASE WHEN NOT price BETWEEN 900 AND 1900 THEN 'price' END) AS violations FROM r""",
)

# --- designs: one campaign per part, ranges from its line items ------------------------

QUANTITY, PRICE = Marginal("quantity", 1, 50), Marginal("price", 900, 100000)
PART = [QUANTITY, PRICE]


def part_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("campaign")).agg(
        F.min("l_quantity").alias("quantity_lower"), F.max("l_quantity").alias("quantity_upper"),
        F.min("l_extendedprice").alias("price_lower"), F.max("l_extendedprice").alias("price_upper"),
    )


CAMPAIGN_SQL = """campaigns AS (
  SELECT l_partkey AS campaign, min(l_quantity) AS ql, max(l_quantity) AS qu, min(l_extendedprice) AS pl, max(l_extendedprice) AS pu
  FROM lineitem GROUP BY l_partkey)"""


def legendre_sql(n: int) -> str:
    """(i, z, w) rows of the Gauss-Legendre rule with n nodes, as SQL text."""
    z, w = np.polynomial.legendre.leggauss(n)
    rows = ", ".join(f"({i}, {float(a)!r}::DOUBLE, {float(b) / 2!r}::DOUBLE)" for i, (a, b) in enumerate(zip(z, w)))
    return f"(SELECT * FROM (VALUES {rows}) AS g(i, z, w))"


def tensor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = design.tensor_design(part_campaigns(spark, sf_dir), PART, 3)
    return runs.withColumn("node_idx", F.array_join(F.col("node_idx").cast("array<string>"), "-"))


register(
    "tensor_design",
    tensor_runs,
    f"""WITH {CAMPAIGN_SQL}, g AS {legendre_sql(4)}
        SELECT campaign, CAST(a.i * 4 + b.i AS BIGINT) AS run_id, ql + (a.z + 1) * 0.5 * (qu - ql) AS quantity,
               pl + (b.z + 1) * 0.5 * (pu - pl) AS price, a.i || '-' || b.i AS node_idx, a.w * b.w AS weight
        FROM campaigns, g a, g b""",
    ["quantity", "price", "weight"],
)

# Ranges of integer columns of the tables.
FOUR = [
    Marginal("linenumber", 1, 7, "DiscreteUniform"), Marginal("quantity", 1, 50, "DiscreteUniform"),
    Marginal("month", 1, 12, "DiscreteUniform"), Marginal("nation", 0, 24, "DiscreteUniform"),
]


def discrete_rule_sql(m: Marginal, n: int) -> str:
    """Gauss rule of the integers lower..upper from their moments (Cholesky), as SQL text."""
    x = (np.arange(m.lower, m.upper + 1) - m.centre) / m.half
    powers = np.vander(x, n + 1, increasing=True)
    moments = powers.T @ powers / len(x)
    r = np.linalg.cholesky(moments).T
    a = [r[k, k + 1] / r[k, k] - (r[k - 1, k] / r[k - 1, k - 1] if k else 0) for k in range(n)]
    b = [r[k + 1, k + 1] / r[k, k] for k in range(n - 1)]
    z, v = np.linalg.eigh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    rows = ", ".join(f"({i}, {float(m.centre + m.half * t)!r}::DOUBLE, {float(c * c)!r}::DOUBLE)" for i, (t, c) in enumerate(zip(z, v[0])))
    return f"(SELECT * FROM (VALUES {rows}) AS g(i, x, w))"


def discrete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-3 collocation grid of four integer parameters for the campaign of every supplier."""
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("campaign"))
    for m in FOUR:
        suppliers = suppliers.withColumns({f"{m.name}_lower": F.lit(float(m.lower)), f"{m.name}_upper": F.lit(float(m.upper))})
    return design.tensor_design(suppliers, FOUR, 3).drop("node_idx")


register(
    "discrete_tensor_design",
    discrete_runs,
    f"""WITH {", ".join(f"g{k} AS {discrete_rule_sql(m, 4)}" for k, m in enumerate(FOUR))}
        SELECT s_suppkey AS campaign, CAST(((g0.i * 4 + g1.i) * 4 + g2.i) * 4 + g3.i AS BIGINT) AS run_id,
               {", ".join(f"g{k}.x AS {m.name}" for k, m in enumerate(FOUR))}, g0.w * g1.w * g2.w * g3.w AS weight
        FROM supplier, g0, g1, g2, g3""",
    [*[m.name for m in FOUR], "weight"],
)

register(
    "sparse_design",
    lambda spark, sf: design.sparse_design(part_campaigns(spark, sf), PART, 3),
    f"""WITH {CAMPAIGN_SQL},
        {", ".join(f"r{n} AS {legendre_sql(n)}" for n in (1, 2, 3))},
        rules AS (SELECT 1 AS l, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3),
        -- levels with l1 + l2 = 4 count +1, with l1 + l2 = 3 count -1
        nodes AS (SELECT a.z AS za, b.z AS zb, a.w * b.w * CASE WHEN a.l + b.l = 4 THEN 1 ELSE -1 END AS w
                  FROM rules a, rules b WHERE a.l + b.l IN (3, 4)),
        merged AS (SELECT round(za, 12) AS za, round(zb, 12) AS zb, sum(w) AS w FROM nodes GROUP BY round(za, 12), round(zb, 12))
        SELECT campaign, ql + (za + 1) * 0.5 * (qu - ql) AS quantity, pl + (zb + 1) * 0.5 * (pu - pl) AS price, w AS weight
        FROM campaigns, merged""",
    ["quantity", "price", "weight"],
)

RATE, COUNT = Marginal("discount", 0.0, 0.1), Marginal("quantity", 1, 50, "DiscreteUniform")


def u_sql(seed: int, name: str, ident: str) -> str:
    return f"(('0x' || substr(md5('{seed}:{name}:' || {ident}), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def random_sql(seed: int, ident: str) -> str:
    return (
        f"{u_sql(seed, 'discount', ident)} * 0.1::DOUBLE AS discount, "
        f"floor(1 + {u_sql(seed, 'quantity', ident)} * 50) AS quantity"
    )


register(
    "random_design",
    lambda spark, sf: design.random_design(
        load(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id")), "run_id", [RATE, COUNT], 11
    ),
    f"SELECT o_orderkey AS run_id, {random_sql(11, 'o_orderkey')} FROM orders",
    ["discount"], 12,
)

register(
    "fresh_sample",
    lambda spark, sf: design.fresh_sample(
        load(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id")), [RATE, COUNT], 12
    ),
    f"""WITH s AS (SELECT s_suppkey * 100 + c AS sample_id FROM supplier, range(100) AS r(c))
        SELECT sample_id, {random_sql(12, "sample_id")} FROM s""",
    ["discount"], 12,
)

register(
    "range_violations",
    lambda spark, sf: documents.marginal_violations(
        load(spark, sf, "lineitem").select(
            "l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")
        ),
        [Marginal("quantity", 5, 45), Marginal("price", 2000, 60000)],
    ),
    """SELECT l_orderkey, l_quantity AS quantity, l_extendedprice AS price FROM lineitem
       WHERE NOT l_quantity BETWEEN 5 AND 45 OR NOT l_extendedprice BETWEEN 2000 AND 60000""",
)
