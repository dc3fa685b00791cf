"""Queries on surrogates and sensitivities.

Two campaigns: the grid on line items (discount x tax) and one with a run per customer
(balance, nation) whose outputs are the order values of each year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.polynomials import Marginal
from ..operators import collate, design, gaussian_process, softmax_surrogate, surrogate, uq
from .design_queries import u_sql
from .tables import GRID, OBSERVED_SQL, load, observed, register

BALANCE, NATION = Marginal("balance", -1000.0, 10000.0), Marginal("nation", 0, 24, "DiscreteUniform")
CUSTOMER = [BALANCE, NATION]
FEATURES = [m.name for m in CUSTOMER]


# --- grid campaign, first-order polynomial: checked against closed-form regression ----------


def split_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item; the first 80 % of the runs (grid nodes) train."""
    rows = observed(spark, sf_dir)
    runs = collate.train_test_split(rows.select("run_id").distinct()).select("run_id", "split")
    return rows.join(runs, "run_id")


REGRESSION_SQL = f"""
{OBSERVED_SQL},
runs AS (SELECT run_id, CASE WHEN row_number() OVER (ORDER BY run_id) - 1 < floor(count(*) OVER () * 0.8::DOUBLE + 1e-9)
                             THEN 'train' ELSE 'test' END AS split
         FROM (SELECT DISTINCT discount * 9 + tax AS run_id FROM observed)),
rows_ AS (SELECT o.*, split FROM observed o JOIN runs ON discount * 9 + tax = run_id),
sums AS (
  SELECT qoi, t, avg(value) AS my, avg(discount) AS m1, avg(tax) AS m2,
         covar_pop(discount, discount) AS s11, covar_pop(tax, tax) AS s22, covar_pop(discount, tax) AS s12,
         covar_pop(discount, value) AS s1y, covar_pop(tax, value) AS s2y, count(*) AS n
  FROM rows_ WHERE split = 'train' GROUP BY qoi, t),
slopes AS (
  SELECT qoi, t, n, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
         (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM sums),
linear AS (SELECT qoi, t, n, my - b1 * m1 - b2 * m2 AS a, b1, b2 FROM slopes)"""


def linear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_observations(spark, sf_dir)
    return surrogate.fit_polynomial(rows.filter("split = 'train'"), GRID, 1)


def linear_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear_coefficients(spark, sf_dir).select(
        "qoi", "t", "n", *[F.get("coefs", F.lit(i)).alias(f"c{i}") for i in range(3)]
    )


# The orthonormal linear polynomials are (discount - 5) / sqrt(10) and (tax - 4) / sqrt(20 / 3).
register(
    "linear_surrogate",
    linear_surrogate,
    f"""WITH {REGRESSION_SQL}
        SELECT qoi, t, n, a + 5 * b1 + 4 * b2 AS c0, b1 * sqrt(10.0::DOUBLE) AS c1, b2 * sqrt(20 / 3.0::DOUBLE) AS c2 FROM linear""",
    ["c0", "c1", "c2"], 4,
)


def surrogate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_observations(spark, sf_dir)
    coefs = surrogate.fit_polynomial(rows.filter("split = 'train'"), GRID, 1)
    return collate.relative_error(uq.evaluate_pce(rows, coefs, GRID, 1), ["qoi", "split"])


register(
    "surrogate_errors",
    surrogate_errors,
    f"""WITH {REGRESSION_SQL},
        p AS (SELECT qoi, split, value, value - (a + b1 * discount + b2 * tax) AS gap FROM rows_ JOIN linear USING (qoi, t))
        SELECT qoi, split, sqrt(sum(gap * gap)) / sqrt(sum(value * value)) AS rel_error, avg(gap * gap) AS mse, count(*) AS n
        FROM p GROUP BY qoi, split""",
    ["rel_error", "mse"], 4,
)


def supplier_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"))
    return design.fresh_sample(runs, GRID, 21)


def gradient_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.gradient_covariance(
        linear_coefficients(spark, sf_dir), supplier_sample(spark, sf_dir), GRID, 1
    )


register(
    "gradient_covariance",
    gradient_covariance,
    f"""WITH {REGRESSION_SQL},
        s AS (SELECT qoi, sum(b1 * b1) AS c11, sum(b1 * b2) AS c12, sum(b2 * b2) AS c22 FROM linear GROUP BY qoi)
        SELECT qoi, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, c11 AS c FROM s
        UNION ALL SELECT qoi, 0, 1, c12 FROM s UNION ALL SELECT qoi, 1, 0, c12 FROM s UNION ALL SELECT qoi, 1, 1, c22 FROM s""",
    ["c"], 5,
)


def gradient_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.squared_gradient_sensitivity(
        linear_coefficients(spark, sf_dir), supplier_sample(spark, sf_dir), GRID, 1
    ).withColumn("sensitivity", F.log10("sensitivity"))


GRADIENT_SQL = f"""{REGRESSION_SQL},
        sample AS (SELECT id, floor({u_sql(21, "discount", "id")} * 11) AS x1, floor({u_sql(21, "tax", "id")} * 9) AS x2
                   FROM (SELECT s_suppkey * 100 + c AS id FROM supplier, range(100) AS r(c))),
        g AS (SELECT qoi, id, sum(2 * (a + b1 * x1 + b2 * x2) * b1) AS g1, sum(2 * (a + b1 * x1 + b2 * x2) * b2) AS g2
              FROM sample, linear GROUP BY qoi, id),
        sens AS (SELECT qoi, 'discount' AS param, log10(avg(g1 * g1)) AS sensitivity FROM g GROUP BY qoi
                 UNION ALL SELECT qoi, 'tax', log10(avg(g2 * g2)) FROM g GROUP BY qoi)"""

register("gradient_sensitivity", gradient_sensitivity, f"WITH {GRADIENT_SQL} SELECT * FROM sens", ["sensitivity"])

# The surrogate's sensitivities over all QoIs, and their ranking.
register(
    "surrogate_total_sensitivity",
    lambda spark, sf: collate.total_sensitivity(gradient_sensitivity(spark, sf)),
    f"""WITH {GRADIENT_SQL}, m AS (SELECT param, avg(sensitivity) AS sensitivity FROM sens GROUP BY param)
        SELECT param, sensitivity, row_number() OVER (ORDER BY sensitivity DESC, param) AS rank FROM m""",
    ["sensitivity"],
)


def surrogate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polynomial's prediction for every run and time index, trained or not."""
    rows = split_observations(spark, sf_dir).select("run_id", "qoi", "t", "split", "discount", "tax").distinct()
    predicted = uq.evaluate_pce(rows, linear_coefficients(spark, sf_dir), GRID, 1)
    return predicted.select("run_id", "qoi", "t", "split", "prediction")


register(
    "surrogate_predictions",
    surrogate_predictions,
    f"""WITH {REGRESSION_SQL}
        SELECT DISTINCT CAST(discount * 9 + tax AS BIGINT) AS run_id, qoi, t, split, a + b1 * discount + b2 * tax AS prediction
        FROM rows_ JOIN linear USING (qoi, t)""",
    ["prediction"], 4,
)


# --- customer campaign ------------------------------------------------------------------------


def customer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation")
    )


def customer_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, qoi, t, value): a customer's order value and number of orders of each year."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    first, last = orders.agg(F.min("y"), F.max("y")).first()
    years = list(range(first, last + 1)) if first else []
    totals = orders.groupBy(F.col("o_custkey").alias("run_id")).agg(
        *[F.sum(F.when(F.col("y") == y, F.col("o_totalprice"))).alias(f"price_{y}") for y in years],
        *[F.sum(F.when(F.col("y") == y, F.lit(1.0))).alias(f"orders_{y}") for y in years],
    )
    everyone = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")).join(totals, "run_id", "left")
    entries = F.array(
        *[
            F.struct(F.lit(q).alias("qoi"), F.lit(i).cast("long").alias("t"), F.coalesce(F.col(f"{q}_{y}"), F.lit(0.0)).alias("value"))
            for q in ("price", "orders") for i, y in enumerate(years)
        ]
    )
    return everyone.select("run_id", F.inline(entries))


CUSTOMER_SQL = f"""
years AS (SELECT min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders),
totals AS (SELECT o_custkey, CAST(year(o_orderdate) - y0 AS BIGINT) AS t, sum(o_totalprice) AS price, count(*)::DOUBLE AS orders
           FROM orders, years GROUP BY ALL),
outputs AS (
  SELECT c_custkey AS run_id, q.qoi, g.t, c_acctbal AS balance, c_nationkey AS nation,
         CASE WHEN q.qoi = 'price' THEN coalesce(price, 0) ELSE coalesce(totals.orders, 0) END::DOUBLE AS value
  FROM customer, (VALUES ('price'), ('orders')) AS q(qoi), (SELECT unnest(range(y1 - y0 + 1)) AS t FROM years) AS g
  LEFT JOIN totals ON o_custkey = c_custkey AND totals.t = g.t)"""

register(
    "campaign_outputs",
    lambda spark, sf: collate.attach_parameters(customer_outputs(spark, sf), customer_runs(spark, sf)),
    f"WITH {CUSTOMER_SQL} SELECT run_id, qoi, t, value, balance, nation::DOUBLE AS nation FROM outputs",
    ["value"], 2,
)


def split_customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(runs, rows) with the split of every run; features scaled to z-scores."""
    runs = collate.train_test_split(collate.standardise(customer_runs(spark, sf_dir), FEATURES))
    rows = collate.attach_parameters(customer_outputs(spark, sf_dir), runs.select("run_id", "split", *FEATURES))
    return runs, rows


def customer_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.fresh_sample(customer_runs(spark, sf_dir), CUSTOMER, 31)


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collate.attach_parameters(customer_outputs(spark, sf_dir), customer_runs(spark, sf_dir))


def active_subspace_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_rows(spark, sf_dir)
    split = collate.train_test_split(customer_runs(spark, sf_dir)).select("run_id", "split")
    rows = rows.join(split, "run_id")
    directions, coefs = surrogate.fit_active_subspace(
        rows.filter("split = 'train'"), customer_sample(spark, sf_dir), CUSTOMER
    )
    return collate.relative_error(surrogate.predict_active_subspace(rows, directions, coefs, CUSTOMER), ["qoi", "split"])


register("active_subspace_errors", active_subspace_errors, doubles=["rel_error", "mse"], digits=4)


def active_subspace_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = customer_sample(spark, sf_dir)
    directions, coefs = surrogate.fit_active_subspace(raw_rows(spark, sf_dir), sample, CUSTOMER)
    s = surrogate.squared_gradient_sensitivity(coefs, sample, CUSTOMER, 3, directions)
    return collate.rank_parameters(s, ["qoi"])


register("active_subspace_sensitivity", active_subspace_sensitivity)


def fitted_process(spark: SparkSession, sf_dir: str):
    runs, rows = split_customers(spark, sf_dir)
    scaled = collate.scale_targets(rows)
    gp = gaussian_process.fit(
        runs.filter("split = 'train'"), scaled.filter("split = 'train'"), FEATURES, inducing=None, noise=1e-2
    )
    return runs, scaled, gp


def gaussian_process_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, rows, gp = fitted_process(spark, sf_dir)
    predicted = gaussian_process.predict(gp, runs, rows.select("run_id", "qoi", "t", "value", "split"))
    return collate.relative_error(predicted, ["qoi", "split"])


register("gaussian_process_errors", gaussian_process_errors, doubles=["rel_error"], digits=4)


def gaussian_process_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled mean gradient and rank per QoI over a fresh sample, scaled like the features."""
    moments = collate.feature_moments(customer_runs(spark, sf_dir), FEATURES)
    sample = collate.standardise(customer_sample(spark, sf_dir), FEATURES, moments)
    gp = fitted_process(spark, sf_dir)[2]
    scaled = collate.min_max_scaled(gaussian_process.mean_gradient(gp, sample), ["qoi"])
    return collate.rank_parameters(scaled, ["qoi"])


register("gaussian_process_sensitivity", gaussian_process_sensitivity, doubles=["sensitivity"])

BINS = 10
register(
    "quantised_targets",
    lambda spark, sf: softmax_surrogate.quantise(
        customer_outputs(spark, sf), softmax_surrogate.bin_ranges(customer_outputs(spark, sf)), BINS
    ).select("run_id", "qoi", "t", "label"),
    f"""WITH {CUSTOMER_SQL},
        r AS (SELECT qoi, t, min(value) AS lo, max(value) AS hi FROM outputs GROUP BY qoi, t)
        SELECT run_id, qoi, t, CASE WHEN hi > lo THEN greatest(0, least({BINS - 1}, floor((value - lo) / (hi - lo) * {BINS})))
                                    ELSE 0 END::DOUBLE AS label FROM outputs JOIN r USING (qoi, t)""",
)


def fitted_softmax(spark: SparkSession, sf_dir: str):
    _, rows = split_customers(spark, sf_dir)
    return rows, softmax_surrogate.fit(rows.filter("split = 'train'"), FEATURES, BINS)


def softmax_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = fitted_softmax(spark, sf_dir)
    return collate.relative_error(softmax_surrogate.predict(model, rows), ["qoi", "split"])


register("softmax_errors", softmax_errors, doubles=["rel_error"], digits=4)


def softmax_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = customer_runs(spark, sf_dir)
    moments = collate.feature_moments(runs, FEATURES)
    sample = collate.standardise(design.fresh_sample(runs, CUSTOMER, 33), FEATURES, moments)
    rows, model = fitted_softmax(spark, sf_dir)
    s = softmax_surrogate.squared_gradient_sensitivity(model, sample, rows)
    return collate.rank_parameters(s, ["qoi"])


register("softmax_sensitivity", softmax_sensitivity)
