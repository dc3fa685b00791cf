"""Queries on block averages and elastic tensors: line items as stress samples.

Material = supplier, direction = line number - 1 (0 is the undeformed state),
orientation = line status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordinal import with_spread_ordinal
from ..operators import elastic
from ..schemas import PRESSURES
from .prep_queries import USER_POSITIONS, user_positions
from .tables import load, register

PRESSURE_SQL = {
    "pxx": "sqrt(l_quantity)",
    "pyy": "sqrt(l_extendedprice)",
    "pzz": "sqrt(l_discount)",
    "pxy": "sqrt(l_tax)",
    "pxz": "sqrt(l_quantity * l_tax)",
    "pyz": "sqrt(l_extendedprice * l_discount)",
}
KEYS = ["material", "dir", "ori"]
ORI_SQL = "CASE WHEN l_linenumber = 1 THEN 'org' WHEN l_linestatus = 'O' THEN 'pos' ELSE 'neg' END"
# Full order of the samples of a series; rows equal in all of it have equal stresses.
ORDER = ["l_shipdate", "l_orderkey", *PRESSURES]


# The same order by the columns they are made of: a root keeps the order.
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def averaged_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("material"), (F.col("l_linenumber") - 1).cast("long").alias("dir"),
        F.expr(ORI_SQL).alias("ori"), "l_shipdate", "l_orderkey", *MEASURES,
    )
    placed = with_spread_ordinal(line, KEYS, ["l_shipdate", "l_orderkey", *MEASURES], "position", "samples")
    samples = placed.select(*KEYS, "position", "samples", *[F.expr(e).alias(n) for n, e in PRESSURE_SQL.items()])
    return elastic.averaged_stress(samples, size="samples")


NAV = "greatest(1, CASE WHEN n > 10000 THEN n // 1000 ELSE n // 10 END)"
STRESS_CTE = f"""
samples AS (
  SELECT l_suppkey AS material, CAST(l_linenumber - 1 AS BIGINT) AS dir, {ORI_SQL} AS ori, l_shipdate, l_orderkey,
         {", ".join(f"{e} AS {n}" for n, e in PRESSURE_SQL.items())} FROM lineitem),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY material, dir, ori ORDER BY {", ".join(ORDER)}) - 1 AS position,
         count(*) OVER (PARTITION BY material, dir, ori) AS n FROM samples),
blocks AS (
  SELECT material, dir, ori, position // {NAV} AS block, {", ".join(f"avg({p}) AS {p}" for p in PRESSURES)}
  FROM placed GROUP BY material, dir, ori, n, block HAVING count(*) = {NAV}),
stress AS (SELECT material, dir, ori, {", ".join(f"avg({p}) AS {p}" for p in PRESSURES)} FROM blocks GROUP BY ALL)"""

register(
    "running_block_means",
    lambda spark, sf: elastic.running_block_means(
        user_positions(spark, sf), ["user_id"], "position", ["value"], rows=load(spark, sf, "events")
    ),
    f"""WITH {USER_POSITIONS},
        sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM placed),
        blocks AS (SELECT user_id, CAST(position // {NAV} AS BIGINT) AS block, avg(value) AS value_block FROM sized
                   GROUP BY user_id, n, block HAVING count(*) = {NAV})
        SELECT user_id, block, value_block,
               avg(value_block) OVER (PARTITION BY user_id ORDER BY block ROWS UNBOUNDED PRECEDING) AS value_running FROM blocks""",
    ["value_block", "value_running"],
)


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order values as the box lengths of a run: mean over halves of the series."""
    orders = load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run_id"), "o_orderkey", F.sqrt("o_totalprice").alias("lx"),
        F.sqrt(F.col("o_totalprice") + F.month("o_orderdate")).alias("ly"), F.sqrt(F.col("o_totalprice") * 2).alias("lz"),
    )
    placed = with_spread_ordinal(orders, ["run_id"], ["o_orderkey"], "position", "samples")
    return elastic.average_lengths(placed, ["run_id"], "position", ["lx", "ly", "lz"], size="samples")


register(
    "average_lengths",
    lengths,
    """WITH o AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position,
                         count(*) OVER (PARTITION BY o_custkey) AS n, sqrt(o_totalprice) AS lx,
                         sqrt(o_totalprice + month(o_orderdate)) AS ly, sqrt(o_totalprice * 2) AS lz FROM orders),
       b AS (SELECT run_id, position // greatest(1, n // 2) AS block, avg(lx) AS lx, avg(ly) AS ly, avg(lz) AS lz
             FROM o GROUP BY run_id, n, block HAVING count(*) = greatest(1, n // 2))
       SELECT run_id, avg(lx) AS lx, avg(ly) AS ly, avg(lz) AS lz FROM b GROUP BY run_id""",
    ["lx", "ly", "lz"],
)

register(
    "averaged_stress",
    averaged_stress,
    f"WITH {STRESS_CTE} SELECT * FROM stress",
    PRESSURES,
)

EEPS = ["eeps_00", "eeps_11", "eeps_22", "eeps_12", "eeps_02", "eeps_01"]


def material_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box lengths and strain state of every material, from the supplier table."""
    s = load(spark, sf_dir, "supplier")
    strains = [F.signum(F.col("s_acctbal") - 1500.0 * k) * (F.col("s_suppkey") % (k + 2)) for k in range(6)]
    return s.select(
        F.col("s_suppkey").alias("material"), (F.col("s_nationkey") + 10.0).alias("lx0"),
        (F.col("s_nationkey") + 12.0).alias("ly0"), (F.col("s_nationkey") + 14.0).alias("lz0"),
        *[e.cast("double").alias(n) for e, n in zip(strains, EEPS)],
    )


STATE_CTE = f"""
states AS (SELECT s_suppkey AS material, {", ".join(f"sign(s_acctbal - {1500 * k}) * (s_suppkey % {k + 2}) AS e{k + 1}" for k in range(6))}
           FROM supplier),
signs AS (SELECT material, j, CASE WHEN e = 0 THEN 1.0 ELSE sign(e) END::DOUBLE AS s FROM (
  {" UNION ALL ".join(f"SELECT material, {j} AS j, e{j} AS e FROM states" for j in range(1, 7))}))"""
VOIGT_ROWS = " UNION ALL ".join(
    f"SELECT material, dir, ori, {v} AS i, {p} AS p FROM stress" for p, v in elastic.VOIGT.items()
)
DIFFERENCE_CTE = f"""
{STRESS_CTE}, {STATE_CTE},
voigt AS ({VOIGT_ROWS}),
differences AS (
  SELECT m.material, m.ori, m.i::BIGINT AS i, m.dir AS j,
         -(m.p - b.p) / (CASE WHEN m.ori = 'neg' THEN -1 ELSE 1 END * s * 0.01::DOUBLE) * 1.01325e-4::DOUBLE AS c
  FROM voigt m JOIN voigt b ON b.dir = 0 AND b.material = m.material AND b.i = m.i
  JOIN signs ON signs.material = m.material AND signs.j = m.dir WHERE m.dir > 0),
means AS (SELECT material, i, j, avg(c) AS c FROM differences GROUP BY ALL),
sym AS (SELECT material, least(i, j) AS i, greatest(i, j) AS j, avg(c) AS c FROM means GROUP BY ALL)"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elastic.stiffness_differences(averaged_stress(spark, sf_dir), material_states(spark, sf_dir))


register(
    "strain_signs",
    lambda spark, sf: material_states(spark, sf).select(
        "material", *[elastic.strain_sign(F.col(e)).alias(e) for e in EEPS]
    ),
    f"""WITH {STATE_CTE} SELECT material, {", ".join(f"max(CASE WHEN j = {j + 1} THEN s END) AS {e}" for j, e in enumerate(EEPS))}
        FROM signs GROUP BY material""",
    EEPS,
)
register("stiffness_differences", differences, f"WITH {DIFFERENCE_CTE} SELECT * FROM differences", ["c"])
register(
    "stiffness_means",
    lambda spark, sf: elastic.combine_orientations(differences(spark, sf)),
    f"WITH {DIFFERENCE_CTE} SELECT * FROM means",
    ["c"],
)
register(
    "one_sided_stiffness",
    lambda spark, sf: elastic.combine_orientations(differences(spark, sf), "pos"),
    f"WITH {DIFFERENCE_CTE} SELECT material, i, j, c FROM differences WHERE ori = 'pos'",
    ["c"],
)
register(
    "symmetric_stiffness",
    lambda spark, sf: elastic.symmetrise(elastic.combine_orientations(differences(spark, sf))),
    f"WITH {DIFFERENCE_CTE} SELECT * FROM sym",
    ["c"],
)
MODULI = ["c11", "c12", "c44", "bulk", "shear1", "shear2", "poisson"]
register(
    "elastic_moduli",
    lambda spark, sf: elastic.cubic_moduli(elastic.symmetrise(elastic.combine_orientations(differences(spark, sf)))),
    f"""WITH {DIFFERENCE_CTE}, cubic AS (
          SELECT material, avg(CASE WHEN i = j AND i <= 3 THEN c END) AS c11, avg(CASE WHEN i < j AND j <= 3 THEN c END) AS c12,
                 avg(CASE WHEN i = j AND i > 3 THEN c END) AS c44 FROM sym GROUP BY material)
        SELECT *, (c11 + 2 * c12) / 3 AS bulk, c44 AS shear1, (c11 - c12) / 2 AS shear2, 1 / (1 + c11 / c12) AS poisson FROM cubic""",
    MODULI,
)
