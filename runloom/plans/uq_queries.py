"""Queries on collated campaigns: moments, Sobol indices and report tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.polynomials import Marginal
from ..functions.workspace import materialise
from ..operators import collate, design, sparse, uq
from .tables import (
    GRID, GRID_SQL, NODES, OBSERVED_SQL, collated, grid_outputs, grid_runs, load, observed, register,
)

ORDER = 3
NAMES = [m.name for m in GRID]


def _orthonormal_values(m: Marginal) -> str:
    """(k, x, v) rows of the discrete orthonormal polynomials by QR, as SQL text."""
    x = np.arange(m.lower, m.upper + 1)
    q, r = np.linalg.qr(np.vander(x - x.mean(), ORDER + 1, increasing=True))
    v = q * np.sign(np.diag(r)) * np.sqrt(len(x))
    rows = ", ".join(f"({k}, {int(xi)}, {float(v[i, k])!r}::DOUBLE)" for i, xi in enumerate(x) for k in range(ORDER + 1))
    return f"(SELECT * FROM (VALUES {rows}) AS u(k, x, v))"


def _pce_sql() -> str:
    return f"""
{GRID_SQL},
basis_discount AS {_orthonormal_values(GRID[0])},
basis_tax AS {_orthonormal_values(GRID[1])},
coefs AS (
  SELECT qoi, t, a.k AS i, b.k AS j, sum(value * a.v * b.v) / count(*) AS c
  FROM collated JOIN basis_discount a ON a.x = discount JOIN basis_tax b ON b.x = tax
  WHERE a.k + b.k <= {ORDER} GROUP BY ALL),
moments AS (
  SELECT qoi, t, sum(CASE WHEN i + j = 0 THEN c END) AS mean, sum(CASE WHEN i + j > 0 THEN c * c END) AS var,
         sqrt(sum(CASE WHEN i + j > 0 THEN c * c END)) AS std
  FROM coefs GROUP BY qoi, t)"""


PCE_SQL = _pce_sql()


def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uq.pce_coefficients(collated(spark, sf_dir), GRID, ORDER)


register(
    "collated_runs",
    lambda spark, sf: collate.attach_parameters(
        collate.collate(grid_outputs(spark, sf).drop(*NAMES), ["run_id", "t"], ["price", "quantity"]),
        grid_runs(spark, sf),
    ),
    f"WITH {GRID_SQL} SELECT run_id, t, qoi, value, discount, tax, 1.0::DOUBLE / {NODES} AS weight FROM collated",
    ["value", "weight"],
)

register(
    "missing_nodes",
    lambda spark, sf: uq.missing_nodes(collated(spark, sf), NODES),
    f"WITH {GRID_SQL} SELECT qoi, t, {NODES} - count(*) AS n_missing FROM collated GROUP BY ALL",
)

register(
    "pce_coefficients",
    lambda spark, sf: uq.coefficient_rows(coefficients(spark, sf), GRID, ORDER),
    f"WITH {PCE_SQL} SELECT qoi, t, i || '-' || j AS term, c AS coef FROM coefs",
    ["coef"],
)

register(
    "pce_moments",
    lambda spark, sf: uq.pce_moments(coefficients(spark, sf), GRID, ORDER),
    f"WITH {PCE_SQL} SELECT * FROM moments",
    ["mean", "var", "std"], 4,
)

for kind, discount_rule, tax_rule in (
    ("first", "i > 0 AND j = 0", "i = 0 AND j > 0"), ("total", "i > 0", "j > 0"),
):
    register(
        f"pce_sobol_{kind}",
        lambda spark, sf, kind=kind: uq.pce_sobol(coefficients(spark, sf), GRID, ORDER, kind),
        f"""WITH {PCE_SQL}
            SELECT qoi, t, param, e / var AS sobol FROM (
              SELECT qoi, t, 'discount' AS param, sum(CASE WHEN {discount_rule} THEN c * c END) AS e FROM coefs GROUP BY qoi, t
              UNION ALL
              SELECT qoi, t, 'tax', sum(CASE WHEN {tax_rule} THEN c * c END) FROM coefs GROUP BY qoi, t
            ) JOIN moments USING (qoi, t)""",
        ["sobol"],
    )

register(
    "pce_sobol_second",
    lambda spark, sf: uq.pce_sobol(coefficients(spark, sf), GRID, ORDER, "second"),
    f"""WITH {PCE_SQL}
        SELECT qoi, t, 'discount' AS param, 'tax' AS param2, sum(CASE WHEN i > 0 AND j > 0 THEN c * c END) / max(var) AS sobol
        FROM coefs JOIN moments USING (qoi, t) GROUP BY qoi, t""",
    ["sobol"],
)


def pce_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expansion evaluated at every line item, summed up per QoI and time."""
    rows = uq.evaluate_pce(observed(spark, sf_dir), coefficients(spark, sf_dir), GRID, ORDER)
    return rows.groupBy("qoi", "t").agg(
        F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"),
        F.min("prediction").alias("min_prediction"), F.max("prediction").alias("max_prediction"),
    )


PREDICTED = f"""
{PCE_SQL}, {OBSERVED_SQL},
nodes AS (
  SELECT qoi, t, a.x AS discount, b.x AS tax, sum(c * a.v * b.v) AS prediction
  FROM coefs JOIN basis_discount a ON a.k = i JOIN basis_tax b ON b.k = j GROUP BY ALL),
predicted AS (SELECT * FROM observed JOIN nodes USING (qoi, t, discount, tax))"""
register(
    "pce_evaluation",
    pce_evaluation,
    f"""WITH {PREDICTED}
        SELECT qoi, t, count(*) AS n, avg(prediction) AS mean_prediction, min(prediction) AS min_prediction,
               max(prediction) AS max_prediction FROM predicted GROUP BY qoi, t""",
    ["mean_prediction", "min_prediction", "max_prediction"], 4,
)

register(
    "prediction_errors",
    lambda spark, sf: collate.relative_error(
        uq.evaluate_pce(observed(spark, sf), coefficients(spark, sf), GRID, ORDER), ["qoi", "t"]
    ),
    f"""WITH {PREDICTED}
        SELECT qoi, t, sqrt(sum((value - prediction) * (value - prediction))) / sqrt(sum(value * value)) AS rel_error,
               avg((value - prediction) * (value - prediction)) AS mse, count(*) AS n
        FROM predicted GROUP BY qoi, t""",
    ["rel_error", "mse"], 4,
)

SC_SQL = f"""
{GRID_SQL},
moments AS (SELECT qoi, t, avg(value) AS mean, var_pop(value) AS var, count(*) AS n_nodes, stddev_pop(value) AS std
            FROM collated GROUP BY qoi, t),
conditional AS (
  SELECT qoi, t, 'discount' AS param, discount AS node, avg(value) AS m, count(*) AS n FROM collated GROUP BY ALL
  UNION ALL
  SELECT qoi, t, 'tax', tax, avg(value), count(*) FROM collated GROUP BY ALL),
first_order AS (
  SELECT qoi, t, param, sum(n * (m - mean) * (m - mean)) / sum(n) / max(var) AS sobol
  FROM conditional JOIN moments USING (qoi, t) GROUP BY ALL)"""

register(
    "sc_moments",
    lambda spark, sf: uq.weighted_moments(materialise(collated(spark, sf), "collated")),
    f"WITH {SC_SQL} SELECT * FROM moments",
    ["mean", "var", "std"], 4,
)


def sc_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uq.sc_first_order(materialise(collated(spark, sf_dir), "collated"), NAMES)


register("sc_sobol_first", sc_first_order, f"WITH {SC_SQL} SELECT * FROM first_order", ["sobol"])

SC_CLOSED_SQL = f"""
{SC_SQL},
closed AS (
  SELECT qoi, t, param, sum(n * (m - mean) * (m - mean)) / sum(n) AS d FROM conditional JOIN (
    SELECT qoi, t, param, sum(n * m) / sum(n) AS mean FROM conditional GROUP BY ALL) USING (qoi, t, param) GROUP BY ALL),
wide AS (SELECT qoi, t, max(CASE WHEN param = 'discount' THEN d END) AS dd, max(CASE WHEN param = 'tax' THEN d END) AS dx
         FROM closed GROUP BY ALL)"""

register(
    "sc_sobol_total",
    lambda spark, sf: uq.sc_sobol(materialise(collated(spark, sf), "collated"), NAMES, "total"),
    f"""WITH {SC_CLOSED_SQL}
        SELECT qoi, t, 'discount' AS param, (var - dx) / var AS sobol FROM wide JOIN moments USING (qoi, t)
        UNION ALL SELECT qoi, t, 'tax', (var - dd) / var FROM wide JOIN moments USING (qoi, t)""",
    ["sobol"],
)

register(
    "sc_sobol_second",
    lambda spark, sf: uq.sc_sobol(materialise(collated(spark, sf), "collated"), NAMES, "second"),
    f"""WITH {SC_CLOSED_SQL}
        SELECT qoi, t, 'discount' AS param, 'tax' AS param2, (var - dd - dx) / var AS sobol FROM wide JOIN moments USING (qoi, t)""",
    ["sobol"],
)

# The same campaign with runs that gave no output: the others are renormalised, the lack is reported.
SC_LOST = "(discount + 2 * tax) % 7 <> 3"
register(
    "sc_sobol_with_gaps",
    lambda spark, sf: uq.sc_sobol(materialise(collated(spark, sf).filter(SC_LOST), "collated"), NAMES, "total", designed=NODES),
    f"""WITH {SC_CLOSED_SQL.replace("collated AS (", "complete AS (", 1).replace(
        "moments AS (", f"collated AS (SELECT * FROM complete WHERE {SC_LOST}), moments AS (", 1)}
        SELECT qoi, t, {NODES} - n_nodes AS n_missing, 'discount' AS param, (var - dx) / var AS sobol
        FROM wide JOIN moments USING (qoi, t)
        UNION ALL SELECT qoi, t, {NODES} - n_nodes, 'tax', (var - dd) / var FROM wide JOIN moments USING (qoi, t)""",
    ["sobol"],
)

register(
    "moment_bands",
    lambda spark, sf: uq.moment_band(uq.weighted_moments(materialise(collated(spark, sf), "collated"))),
    f"WITH {SC_SQL} SELECT qoi, t, mean, mean - std AS lower, mean + std AS upper FROM moments",
    ["mean", "lower", "upper"], 4,
)


def index_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = materialise(coefficients(spark, sf_dir), "coefs")
    return uq.index_curves(uq.pce_moments(c, GRID, ORDER), uq.pce_sobol(c, GRID, ORDER, "total"))


register(
    "index_curves",
    index_curves,
    f"""WITH {PCE_SQL}
        SELECT qoi, t, mean, param, e / var AS sobol FROM (
          SELECT qoi, t, 'discount' AS param, sum(CASE WHEN i > 0 THEN c * c END) AS e FROM coefs GROUP BY qoi, t
          UNION ALL
          SELECT qoi, t, 'tax', sum(CASE WHEN j > 0 THEN c * c END) FROM coefs GROUP BY qoi, t
        ) JOIN moments USING (qoi, t)""",
    ["mean", "sobol"], 4,
)

register(
    "descriptive_statistics",
    lambda spark, sf: uq.describe(observed(spark, sf)),
    f"""WITH {OBSERVED_SQL}
        SELECT qoi, t, avg(value) AS mean, var_pop(value) AS var, stddev_pop(value) AS std, min(value) AS min,
               max(value) AS max, count(value) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90
        FROM observed GROUP BY qoi, t""",
    ["mean", "var", "std", "min", "max", "p10", "p90"], 3,
)


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return uq.histogram(events.select(F.col("event_type").alias("qoi"), F.lit(0).cast("long").alias("t"), "value"))


register(
    "value_histogram",
    value_histogram,
    """WITH r AS (SELECT event_type AS qoi, min(value) AS lo, max(value) AS hi, count(value) AS total FROM events GROUP BY event_type),
       p AS (SELECT qoi, lo, (hi - lo) / 50 AS width, total, value FROM events JOIN r ON event_type = qoi)
       SELECT qoi, CAST(0 AS BIGINT) AS t, CAST(least(floor((value - lo) / width), 49) AS BIGINT) AS bin,
              lo + least(floor((value - lo) / width), 49) * width AS left_edge, count(*) AS count,
              count(*) / (total * width) AS density
       FROM p GROUP BY qoi, lo, width, total, least(floor((value - lo) / width), 49)""",
    ["left_edge", "density"],
)


# --- quasi Monte Carlo on the grid: outputs are looked up at the sampled node --------


# Base points whose outputs one task gathers: the table of customers is a small file for its rows.
TASK_BASES = 50_000


def base_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(one base point per customer, their number), spread over tasks of bounded size."""
    bases = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("base"))
    n = bases.count()
    return bases.repartition(max(spark.sparkContext.defaultParallelism, -(-n // TASK_BASES))), n


def qmc_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks A, B, AB_i with one base point per customer, valued by the campaign's outputs."""
    bases = base_points(spark, sf_dir)[0]
    runs = design.quasi_random_design(bases, "base", GRID)
    values = collated(spark, sf_dir).select("discount", "tax", "qoi", "t", "value")
    runs = runs.withColumns({n: F.col(n).cast("long") for n in NAMES})
    # Sent to all tasks, as the grid has few nodes: by node, a few partitions would hold all runs.
    return runs.select("base", "block", *NAMES).join(F.broadcast(values), NAMES)


def _sobol_sql(dim: int) -> str:
    v = ", ".join(f"{x}::BIGINT" for x in design.sobol_vectors(dim))
    picked = f"list_transform(range({design.SOBOL_BITS}), lambda b: CASE WHEN ((base + 2) >> b) & 1 = 1 THEN ([{v}])[b + 1] ELSE 0::BIGINT END)"
    return f"list_reduce({picked}, lambda p, q: xor(p, q)) / {2 ** design.SOBOL_BITS}::DOUBLE"


QMC_RUNS = f"""
points AS (
  SELECT c_custkey AS base, {", ".join(f"{_sobol_sql(d)} AS u{d}" for d in range(4))}
  FROM (SELECT c_custkey, c_custkey AS base FROM customer)),
runs AS (
  SELECT base, 0 AS k, 'A' AS block, u0 AS x, u1 AS y FROM points
  UNION ALL SELECT base, 1, 'B', u2, u3 FROM points
  UNION ALL SELECT base, 2, 'AB_discount', u2, u1 FROM points
  UNION ALL SELECT base, 3, 'AB_tax', u0, u3 FROM points)"""

register(
    "quasi_random_runs",
    lambda spark, sf: design.quasi_random_design(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("base")), "base", GRID
    ).select("run_id", "base", "block", *NAMES),
    f"""WITH {QMC_RUNS}
        SELECT base * 4 + k AS run_id, base, block, floor(x * 11) AS discount, floor(y * 9) AS tax FROM runs""",
    NAMES,
)

def qmc_indices(spark: SparkSession, sf_dir: str, kept: str = "true") -> DataFrame:
    outputs = qmc_outputs(spark, sf_dir).filter(kept)
    return uq.qmc_sobol(outputs, NAMES, load(spark, sf_dir, "customer").count())


def _qmc_sql(kept: str = "true") -> str:
    return f"""WITH {GRID_SQL}, {QMC_RUNS},
        valued AS (SELECT qoi, t, base, block, value FROM runs JOIN collated
                   ON CAST(floor(x * 11) AS BIGINT) = discount AND CAST(floor(y * 9) AS BIGINT) = tax WHERE {kept}),
        f AS (SELECT qoi, t, base, max(CASE WHEN block = 'A' THEN value END) AS a, max(CASE WHEN block = 'B' THEN value END) AS b,
                     max(CASE WHEN block = 'AB_discount' THEN value END) AS d, max(CASE WHEN block = 'AB_tax' THEN value END) AS x
              FROM valued GROUP BY ALL),
        c AS (SELECT qoi, t, count(a + b + d + x) AS n_bases, (SELECT count(*) FROM customer) - count(a + b + d + x) AS n_incomplete
              FROM f GROUP BY qoi, t),
        s AS (SELECT qoi, t, (avg(a) + avg(b)) / 2 AS mean,
                     (var_pop(a) + var_pop(b)) / 2 + ((avg(a) - avg(b)) / 2) * ((avg(a) - avg(b)) / 2) AS var,
                     avg(b * (d - a)) AS sd, avg(b * (x - a)) AS sx, avg((a - d) * (a - d)) / 2 AS td, avg((a - x) * (a - x)) / 2 AS tx
              FROM f WHERE a + b + d + x IS NOT NULL GROUP BY qoi, t)
        SELECT qoi, t, n_bases, n_incomplete, mean, var, 'discount' AS param, sd / var AS sobol_first, td / var AS sobol_total
        FROM c LEFT JOIN s USING (qoi, t)
        UNION ALL SELECT qoi, t, n_bases, n_incomplete, mean, var, 'tax', sx / var, tx / var FROM c LEFT JOIN s USING (qoi, t)"""


register("qmc_sobol", qmc_indices, _qmc_sql(), ["mean", "var", "sobol_first", "sobol_total"], 4)

# The same campaign with runs that gave no output.
LOST = "(discount + 2 * tax) % 7 <> 3"
register(
    "qmc_sobol_with_gaps", lambda spark, sf: qmc_indices(spark, sf, LOST), _qmc_sql(LOST),
    ["mean", "var", "sobol_first", "sobol_total"], 4,
)


def _second_sql() -> str:
    runs = QMC_RUNS[: QMC_RUNS.rindex(")")] + """
  UNION ALL SELECT base, 4, 'BA_discount', u0, u3 FROM points
  UNION ALL SELECT base, 5, 'BA_tax', u2, u1 FROM points)"""
    picks = ", ".join(f"max(CASE WHEN block = '{b}' THEN value END) AS {n}" for b, n in (
        ("A", "a"), ("B", "b"), ("AB_discount", "ad"), ("AB_tax", "ax"), ("BA_discount", "bd"), ("BA_tax", "bx")))
    return f"""WITH {GRID_SQL}, {runs},
        valued AS (SELECT qoi, t, base, block, value FROM runs JOIN collated
                   ON CAST(floor(x * 11) AS BIGINT) = discount AND CAST(floor(y * 9) AS BIGINT) = tax),
        f AS (SELECT qoi, t, base, {picks} FROM valued GROUP BY ALL),
        c AS (SELECT qoi, t, count(a + b + ad + ax + bd + bx) AS n_bases,
                (SELECT count(*) FROM customer) - count(a + b + ad + ax + bd + bx) AS n_incomplete FROM f GROUP BY qoi, t),
        s AS (SELECT qoi, t, (var_pop(a) + var_pop(b)) / 2 + ((avg(a) - avg(b)) / 2) * ((avg(a) - avg(b)) / 2) AS var,
                     avg(bd * ax - a * b) - avg(b * (ad - a)) - avg(b * (ax - a)) AS e
              FROM f WHERE a + b + ad + ax + bd + bx IS NOT NULL GROUP BY qoi, t)
        SELECT qoi, t, n_bases, n_incomplete, 'discount' AS param, 'tax' AS param2, e / var AS sobol_second
        FROM c LEFT JOIN s USING (qoi, t)"""


def qmc_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair index with one base point per customer, 2 d + 2 runs each, valued by the campaign's outputs."""
    bases, designed = base_points(spark, sf_dir)
    runs = design.quasi_random_design(bases, "base", GRID, second_order=True)
    runs = runs.withColumns({n: F.col(n).cast("long") for n in NAMES})
    outputs = runs.select("base", "block", *NAMES).join(
        F.broadcast(collated(spark, sf_dir).select(*NAMES, "qoi", "t", "value")), NAMES)
    return uq.qmc_second_order(outputs, NAMES, designed)


register("qmc_sobol_second", qmc_second, _second_sql(), ["sobol_second"], 4)


# --- quadrature designs between the grid's nodes: a run takes the outputs of the nearest node ------

SPARSE = sparse.SparseGrid(tuple(GRID), 4)


def designed_outputs(spark: SparkSession, sf_dir: str, runs: DataFrame) -> DataFrame:
    """(runs' columns, qoi, t, value): outputs of the campaign at the integers next to a run's parameters."""
    near = {n: F.round(n).cast("long") for n in NAMES}
    values = collated(spark, sf_dir).select(*[F.col(n).alias(f"_{n}") for n in NAMES], "qoi", "t", "value")
    return runs.withColumns({f"_{n}": c for n, c in near.items()}).join(values, [f"_{n}" for n in NAMES]).drop(
        *[f"_{n}" for n in NAMES])


def weighted_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a 6 x 6 Gauss design, whose nodes weigh unequally."""
    runs = design.tensor_design(design.campaign_row(spark, GRID), GRID, 5)
    return uq.weighted_describe(materialise(designed_outputs(spark, sf_dir, runs), "designed"))


def _gauss_sql(m: Marginal, order: int) -> str:
    z, w = design.gauss_rule(m, order)
    return ", ".join(f"({round(m.centre + float(a) * m.half)}, {float(b)!r}::DOUBLE)" for a, b in zip(z, w))


register(
    "weighted_statistics",
    weighted_statistics,
    f"""WITH {GRID_SQL},
        gd(discount, wd) AS (VALUES {_gauss_sql(GRID[0], 5)}), gx(tax, wx) AS (VALUES {_gauss_sql(GRID[1], 5)}),
        runs AS (SELECT qoi, t, value, wd * wx AS w FROM gd CROSS JOIN gx JOIN collated USING (discount, tax)),
        m AS (SELECT qoi, t, sum(w * value) / sum(w) AS mean, sum(w) AS weight_sum, min(value) AS min, max(value) AS max,
                     count(*) AS n FROM runs GROUP BY ALL),
        v AS (SELECT qoi, t, sum(w * (value - mean) * (value - mean)) / sum(w) AS var FROM runs JOIN m USING (qoi, t) GROUP BY ALL),
        s AS (SELECT qoi, t, value, weight_sum, sum(w) OVER (PARTITION BY qoi, t ORDER BY value) AS upto FROM runs JOIN m USING (qoi, t)),
        p AS (SELECT qoi, t, min(CASE WHEN upto >= 0.1 * weight_sum - 1e-12 THEN value END) AS p10,
                     min(CASE WHEN upto >= 0.9 * weight_sum - 1e-12 THEN value END) AS p90 FROM s GROUP BY ALL)
        SELECT qoi, t, mean, var, sqrt(var) AS std, min, max, n, weight_sum, p10, p90 FROM m JOIN v USING (qoi, t) JOIN p USING (qoi, t)""",
    ["mean", "var", "std", "min", "max", "weight_sum", "p10", "p90"], 4,
)


def sparse_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sparse.sparse_runs(design.campaign_row(spark, GRID), SPARSE)
    return designed_outputs(spark, sf_dir, runs).select("node", "qoi", "t", "value")


def sparse_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(sparse.sparse_coefficients(sparse_outputs(spark, sf_dir), SPARSE), "sparse")


def _sparse_members_sql() -> str:
    """(tensor, coef, i, j, l1, l2, x, y, w) of every node of every tensor, written out from the Gauss rules."""
    rows = []
    for k, (ls, coef) in enumerate(design.combination(len(GRID), SPARSE.level)):
        (z1, w1), (z2, w2) = (design.gauss_rule(m, n - 1) for m, n in zip(GRID, ls))
        rows += [(k, coef, i, j, *ls, GRID[0].centre + float(a) * GRID[0].half, GRID[1].centre + float(b) * GRID[1].half, float(p * q))
                 for i, (a, p) in enumerate(zip(z1, w1)) for j, (b, q) in enumerate(zip(z2, w2))]
    values = ", ".join(f"({k}, {c}, {i}, {j}, {a}, {b}, {x!r}::DOUBLE, {y!r}::DOUBLE, {w!r}::DOUBLE)" for k, c, i, j, a, b, x, y, w in rows)
    return f"members(tensor, coef, i, j, l1, l2, x, y, w) AS (VALUES {values})"


def _polynomial_sql(m: Marginal, v: str) -> list[str]:
    """Orthonormal polynomials over the integers of the range as SQL, by Gram-Schmidt on powers."""
    x = np.arange(m.lower, m.upper + 1) - m.centre
    q, r = np.linalg.qr(np.vander(x, SPARSE.level, increasing=True))
    powers = np.linalg.inv(r) * np.sign(np.diag(r)) * np.sqrt(len(x))
    return [" + ".join(f"{float(powers[k, n])!r}::DOUBLE * ({v} - {m.centre})**{k}" for k in range(n + 1)) for n in range(SPARSE.level)]


SPARSE_SQL = f"""
{GRID_SQL}, {_sparse_members_sql()},
degrees AS (
  SELECT tensor, coef * w AS cw, x, y, a, b,
    CASE a {" ".join(f"WHEN {n} THEN {e}" for n, e in enumerate(_polynomial_sql(GRID[0], "x")))} END AS pa,
    CASE b {" ".join(f"WHEN {n} THEN {e}" for n, e in enumerate(_polynomial_sql(GRID[1], "y")))} END AS pb
  FROM members, range({SPARSE.level}) r(a), range({SPARSE.level}) s(b) WHERE a < l1 AND b < l2),
met AS (
  SELECT * FROM members JOIN collated ON discount = CAST(round(x) AS BIGINT) AND tax = CAST(round(y) AS BIGINT)),
whole AS (SELECT qoi, t, true AS whole FROM met GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM members)),
coefs AS (
  SELECT qoi, t, a, b, CASE WHEN max(whole) THEN sum(cw * pa * pb * value) END AS c FROM degrees
  JOIN collated ON discount = CAST(round(x) AS BIGINT) AND tax = CAST(round(y) AS BIGINT)
  LEFT JOIN whole USING (qoi, t) GROUP BY ALL),
moments AS (SELECT qoi, t, sum(CASE WHEN a + b = 0 THEN c END) AS mean, sum(CASE WHEN a + b > 0 THEN c * c END) AS var
            FROM coefs GROUP BY ALL)"""

register(
    "sparse_moments",
    lambda spark, sf: sparse.sparse_moments(sparse_coefficients(spark, sf)),
    f"WITH {SPARSE_SQL} SELECT qoi, t, mean, var, sqrt(var) AS std FROM moments",
    ["mean", "var", "std"], 4,
)

register(
    "sparse_sobol",
    lambda spark, sf: sparse.sparse_sobol(sparse_coefficients(spark, sf), NAMES, "first").withColumnRenamed("sobol", "first").join(
        sparse.sparse_sobol(sparse_coefficients(spark, sf), NAMES, "total").withColumnRenamed("sobol", "total"), ["qoi", "t", "param"]),
    f"""WITH {SPARSE_SQL}
        SELECT qoi, t, 'discount' AS param, sum(CASE WHEN a > 0 AND b = 0 THEN c * c END) / max(var) AS first,
               sum(CASE WHEN a > 0 THEN c * c END) / max(var) AS total FROM coefs JOIN moments USING (qoi, t) GROUP BY qoi, t
        UNION ALL
        SELECT qoi, t, 'tax', sum(CASE WHEN a = 0 AND b > 0 THEN c * c END) / max(var), sum(CASE WHEN b > 0 THEN c * c END) / max(var)
        FROM coefs JOIN moments USING (qoi, t) GROUP BY qoi, t""",
    ["first", "total"],
)

register(
    "sparse_sobol_second",
    lambda spark, sf: sparse.sparse_sobol(sparse_coefficients(spark, sf), NAMES, "second"),
    f"""WITH {SPARSE_SQL}
        SELECT qoi, t, 'discount' AS param, 'tax' AS param2, sum(CASE WHEN a > 0 AND b > 0 THEN c * c END) / max(var) AS sobol
        FROM coefs JOIN moments USING (qoi, t) GROUP BY qoi, t""",
    ["sobol"],
)


def sparse_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse interpolant at one new point per supplier, QoI and time."""
    return sparse.evaluate_sparse(supplier_points(spark, sf_dir), sparse_coefficients(spark, sf_dir), SPARSE).select(
        "sample_id", "qoi", "t", "prediction")


# Here by Lagrange polynomials on each tensor, added up with the tensors' signs.
register(
    "sparse_predictions",
    sparse_predictions,
    f"""WITH {GRID_SQL}, {_sparse_members_sql()},
        points AS (SELECT s_suppkey AS id, s_suppkey % 40 / 4.0::DOUBLE AS px, s_nationkey % 17 / 2.0::DOUBLE AS py FROM supplier),
        ax AS (SELECT DISTINCT tensor, i, x FROM members), ay AS (SELECT DISTINCT tensor, j, y FROM members),
        lx AS (SELECT p.px, a.tensor, a.i, coalesce(product((p.px - o.x) / (a.x - o.x)), 1.0) AS w
               FROM (SELECT DISTINCT px FROM points) p, ax a LEFT JOIN ax o ON a.tensor = o.tensor AND a.i <> o.i GROUP BY ALL),
        ly AS (SELECT p.py, a.tensor, a.j, coalesce(product((p.py - o.y) / (a.y - o.y)), 1.0) AS w
               FROM (SELECT DISTINCT py FROM points) p, ay a LEFT JOIN ay o ON a.tensor = o.tensor AND a.j <> o.j GROUP BY ALL)
        SELECT id AS sample_id, qoi, t,
               CASE WHEN count(*) = (SELECT count(*) FROM members) THEN sum(coef * lx.w * ly.w * value) END AS prediction
        FROM points JOIN lx USING (px) JOIN ly USING (py, tensor) JOIN members USING (tensor, i, j)
        JOIN collated ON discount = CAST(round(x) AS BIGINT) AND tax = CAST(round(y) AS BIGINT) GROUP BY ALL""",
    ["prediction"], 3,
)


# --- interpolation on the grid ---------------------------------------------------------


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point between the grid's nodes per supplier, for every QoI and time."""
    supplier = load(spark, sf_dir, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("sample_id"), (F.col("s_suppkey") % 40 / 4.0).alias("discount"),
        (F.col("s_nationkey") % 17 / 2.0).alias("tax"), F.explode(F.array(F.lit("price"), F.lit("quantity"))).alias("qoi"),
    ).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))


def sc_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's outputs between its nodes: one new point per supplier."""
    points, nodes = supplier_points(spark, sf_dir), [list(range(11)), list(range(9))]
    return uq.evaluate_sc(points, collated(spark, sf_dir), NAMES, nodes).select("sample_id", "qoi", "t", "prediction")


register(
    "sc_interpolation",
    sc_interpolation,
    f"""WITH {GRID_SQL},
        points AS (SELECT s_suppkey AS id, s_suppkey % 40 / 4.0::DOUBLE AS x, s_nationkey % 17 / 2.0::DOUBLE AS y FROM supplier),
        lx AS (SELECT x, j, product((x - k) / (j - k)::DOUBLE) AS w FROM (SELECT DISTINCT x FROM points), range(11) a(j), range(11) b(k)
               WHERE j <> k GROUP BY x, j),
        ly AS (SELECT y, j, product((y - k) / (j - k)::DOUBLE) AS w FROM (SELECT DISTINCT y FROM points), range(9) a(j), range(9) b(k)
               WHERE j <> k GROUP BY y, j)
        SELECT id AS sample_id, qoi, t, CASE WHEN count(*) = 99 THEN sum(lx.w * ly.w * value) END AS prediction
        FROM points JOIN lx USING (x) JOIN ly USING (y) JOIN collated ON discount = lx.j AND tax = ly.j GROUP BY ALL""",
    ["prediction"], 3,
)


# --- feature tables -----------------------------------------------------------------


def run_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = collate.run_vectors(collated(spark, sf_dir))
    cents = F.transform("target", lambda v: F.round(v * 100).cast("long").cast("string"))
    return vectors.select("run_id", "qoi", F.array_join(cents, ",").alias("target"))


register(
    "run_vectors",
    run_vectors,
    f"""WITH {GRID_SQL} SELECT run_id, qoi, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY t) AS target
        FROM collated GROUP BY run_id, qoi""",
)


def customer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("campaign"), F.col("c_custkey").alias("run_id")
    )
    return collate.train_test_split(runs, 0.2, "campaign")


register(
    "train_test_split",
    customer_split,
    """SELECT c_mktsegment AS campaign, c_custkey AS run_id,
              CAST(row_number() OVER w - 1 AS BIGINT) AS position,
              CASE WHEN row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.8::DOUBLE + 1e-9)
                   THEN 'train' ELSE 'test' END AS split
       FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)""",
)

register(
    "scaled_targets",
    lambda spark, sf: collate.scale_targets(collated(spark, sf)).select("run_id", "qoi", "t", "value"),
    f"""WITH {GRID_SQL} SELECT run_id, qoi, t, value / sqrt(sum(value * value) OVER (PARTITION BY qoi)) AS value FROM collated""",
    ["value"], 9,
)

register(
    "matrix_norms",
    lambda spark, sf: collate.matrix_norms(observed(spark, sf), ["qoi", "t"]),
    f"WITH {OBSERVED_SQL} SELECT qoi, t, sqrt(sum(value * value)) AS norm FROM observed GROUP BY qoi, t",
    ["norm"], 3,
)

ORDER_FEATURES = ["price", "month"]


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("price"),
        F.month("o_orderdate").cast("double").alias("month"),
    )


register(
    "standardised_features",
    lambda spark, sf: collate.standardise(order_features(spark, sf), ORDER_FEATURES),
    """WITH f AS (SELECT o_orderkey AS run_id, o_totalprice AS price, month(o_orderdate)::DOUBLE AS month FROM orders),
       m AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(month) AS wm, stddev_pop(month) AS ws FROM f)
       SELECT run_id, (price - pm) / ps AS price, (month - wm) / ws AS month FROM f, m""",
    ORDER_FEATURES,
)

register(
    "norm_scaled_features",
    lambda spark, sf: collate.scale_features(order_features(spark, sf), ORDER_FEATURES),
    """WITH f AS (SELECT o_orderkey AS run_id, o_totalprice AS price, month(o_orderdate)::DOUBLE AS month FROM orders),
       m AS (SELECT sqrt(sum(price * price + month * month)) AS n FROM f)
       SELECT run_id, price / n AS price, month / n AS month FROM f, m""",
    ORDER_FEATURES, 9,
)



def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all features, standardised with the moments of the training runs."""
    features = order_features(spark, sf_dir)
    moments = collate.feature_moments(collate.train_test_split(features).filter("split = 'train'"), ORDER_FEATURES)
    return collate.feature_summary(collate.standardise(features, ORDER_FEATURES, moments), ORDER_FEATURES)


register(
    "feature_summary",
    feature_summary,
    """WITH f AS (SELECT o_orderkey AS run_id, o_totalprice AS price, month(o_orderdate)::DOUBLE AS month FROM orders),
       placed AS (SELECT *, row_number() OVER (ORDER BY run_id) - 1 AS position, count(*) OVER () AS n FROM f),
       m AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(month) AS wm, stddev_pop(month) AS ws FROM placed
             WHERE position < floor(n * 0.8::DOUBLE + 1e-9))
       SELECT 'price' AS param, avg((price - pm) / ps) AS mean FROM f, m
       UNION ALL SELECT 'month', avg((month - wm) / ws) FROM f, m""",
    ["mean"],
)


def index_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total index averaged over time, as the sensitivity of each QoI."""
    total = uq.pce_sobol(coefficients(spark, sf_dir), GRID, ORDER, "total")
    return total.groupBy("qoi", "param").agg(F.avg("sobol").alias("sensitivity"))


SENSITIVITY_SQL = f"""
{PCE_SQL},
total AS (
  SELECT qoi, t, 'discount' AS param, sum(CASE WHEN i > 0 THEN c * c END) AS e FROM coefs GROUP BY qoi, t
  UNION ALL SELECT qoi, t, 'tax', sum(CASE WHEN j > 0 THEN c * c END) FROM coefs GROUP BY qoi, t),
sens AS (SELECT qoi, param, avg(e / var) AS sensitivity FROM total JOIN moments USING (qoi, t) GROUP BY ALL)"""

register(
    "parameter_ranking",
    lambda spark, sf: collate.rank_parameters(index_sensitivity(spark, sf), ["qoi"]),
    f"""WITH {SENSITIVITY_SQL}
        SELECT qoi, param, sensitivity, row_number() OVER (PARTITION BY qoi ORDER BY sensitivity DESC, param) AS rank FROM sens""",
    ["sensitivity"],
)

register(
    "total_sensitivity",
    lambda spark, sf: collate.total_sensitivity(index_sensitivity(spark, sf)),
    f"""WITH {SENSITIVITY_SQL}, m AS (SELECT param, avg(sensitivity) AS sensitivity FROM sens GROUP BY param)
        SELECT param, sensitivity, row_number() OVER (ORDER BY sensitivity DESC, param) AS rank FROM m""",
    ["sensitivity"],
)

register(
    "scaled_total_sensitivity",
    lambda spark, sf: collate.total_sensitivity(index_sensitivity(spark, sf), scaled=True),
    f"""WITH {SENSITIVITY_SQL}, m AS (SELECT param, avg(sensitivity) AS s FROM sens GROUP BY param),
        z AS (SELECT param, coalesce((s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0), 0) AS sensitivity FROM m)
        SELECT param, sensitivity, row_number() OVER (ORDER BY sensitivity DESC, param) AS rank FROM z""",
    ["sensitivity"],
)


def campaign_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collate the grid campaign; mean, spread and first-order indices per QoI and time."""
    table = materialise(collated(spark, sf_dir), "collated")
    moments = uq.weighted_moments(table)
    first = uq.sc_first_order(table, NAMES, moments)
    return moments.select("qoi", "t", "mean", "std").join(first, ["qoi", "t"])


register(
    "campaign_report",
    campaign_report,
    f"WITH {SC_SQL} SELECT qoi, t, mean, std, param, sobol FROM moments JOIN first_order USING (qoi, t)",
    ["mean", "std", "sobol"], 4,
)
