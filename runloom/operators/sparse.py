"""Campaigns on Smolyak grids: runs, moments, indices and predictions from the same node table.

A sparse grid is a signed sum of small tensor grids. ``members`` says which node belongs to
which tensor, so that an output at a node, run once, is used in every tensor that has it. Each
tensor projects onto the polynomials that its Gauss rules resolve, at most one degree below the
number of points per dimension; on Gauss nodes this projection is the tensor's Lagrange interpolant, so
the signed sum of projections is the sparse interpolant too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import join_group_stats
from ..functions.polynomials import Marginal, gauss_rule, horner, monomials, standardised
from .design import _scaled, _without_bounds, combination, level_size
from .uq import GROUP, _share

# Nodes that one generated row grows into.
BLOCK = 4096


@dataclass(frozen=True)
class SparseGrid:
    """The marginals and levels of a grid; its tables are made by Spark."""

    marginals: tuple[Marginal, ...]
    level: int
    growth: bool = False

    def size(self, level: int) -> int:
        return level_size(level, self.growth)

    def rules(self, m: Marginal) -> list[tuple[list[float], list[int], list[float]]]:
        """Per level the nodes of one dimension, their numbers among the nodes of all levels, and weights."""
        found = [gauss_rule(m, self.size(n) - 1) for n in range(1, self.level + 1)]
        known = [[round(float(v), 12) + 0.0 for v in z] for z, _ in found]
        number = {v: i for i, v in enumerate(sorted({v for z in known for v in z}))}
        return [([float(v) for v in z], [number[v] for v in k], [float(v) for v in w]) for k, (z, w) in zip(known, found)]


def members(spark: SparkSession, grid: SparseGrid) -> DataFrame:
    """(tensor, coef, levels, node, z, w): each node of each tensor, with the tensor's sign and weight.

    ``node`` names a node by its numbers per dimension, so it is the same in all tensors. The driver lists the
    tensors (their levels only); nodes are made by index arithmetic in blocks.
    """
    tensors = [(k, float(c), list(ls), int(np.prod([grid.size(n) for n in ls]))) for k, (ls, c) in enumerate(
        combination(len(grid.marginals), grid.level))]
    table = spark.createDataFrame(tensors, "tensor int, coef double, levels array<int>, total long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(BLOCK).cast("long"))
    blocks = table.withColumn("_first", F.explode(starts))
    if sum(t[3] for t in tensors) > BLOCK:
        blocks = blocks.repartition("tensor", "_first")
    last = F.least(F.col("_first") + (BLOCK - 1), F.col("total") - 1)
    rows = blocks.withColumn("_at", F.explode(F.sequence("_first", last)))
    stride, names, zs, weight = F.lit(1).cast("long"), [], [], F.lit(1.0)
    for i, m in reversed(list(enumerate(grid.marginals))):
        rules = grid.rules(m)
        sizes = F.array(*[F.lit(len(z)).cast("long") for z, _, _ in rules])
        level = F.get("levels", F.lit(i)) - 1
        digit = (F.floor(F.col("_at") / stride) % F.get(sizes, level)).cast("int")

        def pick(part: int, kind, rules=rules, level=level, digit=digit) -> Column:
            return F.get(F.get(F.array(*[F.array(*[F.lit(kind(v)) for v in r[part]]) for r in rules]), level), digit)

        zs.insert(0, pick(0, float))
        names.insert(0, pick(1, int).cast("string"))
        weight = weight * pick(2, float)
        stride = stride * F.get(sizes, level)
    return rows.select("tensor", "coef", "levels", F.concat_ws("-", *names).alias("node"), F.array(*zs).alias("z"), weight.alias("w"))


def sparse_runs(campaigns: DataFrame, grid: SparseGrid) -> DataFrame:
    """One run per campaign and node: (keys, node, parameters, weight); weights of merged nodes are added, with sign."""
    nodes = members(campaigns.sparkSession, grid).groupBy("node").agg(
        F.min("z").alias("_z"), F.sum(F.col("coef") * F.col("w")).alias("weight"))
    # The same grid for every campaign: the few campaigns meet the nodes by a constant key.
    keyed = campaigns.withColumn("_one", F.lit(1)).join(nodes.withColumn("_one", F.lit(1)), "_one")
    for i, m in enumerate(grid.marginals):
        keyed = keyed.withColumn(m.name, _scaled(m, F.get("_z", F.lit(i))))
    return _without_bounds(keyed, list(grid.marginals)).drop("_one", "_z")


def projection(spark: SparkSession, grid: SparseGrid) -> DataFrame:
    """(node, term, b): what an output at the node adds to the coefficient of each polynomial.

    The sum over the node's tensors of sign x weight x polynomial, for the degrees that the
    tensor resolves. It does not depend on any output.
    """
    rows = members(spark, grid)
    for i, m in enumerate(grid.marginals):
        polys = monomials(m, grid.size(grid.level) - 1)
        values = F.array(*[horner(c, F.get("z", F.lit(i))) for c in polys])
        sizes = F.array(*[F.lit(grid.size(n)) for n in range(1, grid.level + 1)])
        own = F.slice(values, F.lit(1), F.get(sizes, F.get("levels", F.lit(i)) - 1))
        rows = rows.select("*", F.posexplode(own).alias(f"_a{i}", f"_p{i}"))
    degrees = [F.col(f"_a{i}") for i in range(len(grid.marginals))]
    product = F.col("coef") * F.col("w")
    for i in range(len(grid.marginals)):
        product = product * F.col(f"_p{i}")
    return rows.select("node", F.array(*degrees).alias("term"), product.alias("b")).groupBy("node", "term").agg(F.sum("b").alias("b"))


def sparse_coefficients(collated: DataFrame, grid: SparseGrid, basis: DataFrame | None = None) -> DataFrame:
    """(qoi, t, term, coef, n_nodes) from outputs (qoi, t, node, value) at all nodes of the grid.

    An output that lacks a node has null coefficients: unlike a tensor rule, a signed sum cannot be
    renormalised over what is present. ``n_nodes`` says how many nodes it has.
    """
    spark = collated.sparkSession
    basis = projection(spark, grid) if basis is None else basis
    designed = members(spark, grid).agg(F.count_distinct("node")).first()[0]
    seen = collated.filter(F.col("value").isNotNull()).groupBy(*GROUP).agg(F.count_distinct("node").alias("n_nodes"))
    sums = collated.join(basis, "node").groupBy(*GROUP, "term").agg(F.sum(F.col("value") * F.col("b")).alias("coef"))
    return join_group_stats(sums, seen, GROUP).withColumn("coef", F.when(F.col("n_nodes") == designed, F.col("coef")))


def sparse_moments(coefs: DataFrame) -> DataFrame:
    """(qoi, t, mean, var, std) from the coefficients."""
    varies = F.exists("term", lambda a: a > 0)
    square = F.col("coef") * F.col("coef")
    return coefs.groupBy(*GROUP).agg(
        F.sum(F.when(~varies, F.col("coef"))).alias("mean"), F.sum(F.when(varies, square)).alias("var")
    ).withColumn("std", F.sqrt("var"))


def sparse_sobol(coefs: DataFrame, params: list[str], kind: str) -> DataFrame:
    """Sobol indices ``first``, ``total`` or ``second``, as ``uq.pce_sobol`` gives them; null without coefficients."""
    support = F.filter(F.sequence(F.lit(0), F.lit(len(params) - 1)), lambda i: F.get("term", i) > 0)
    rows = coefs.select(*GROUP, (F.col("coef") * F.col("coef")).alias("e"), support.alias("s")).filter(F.size("s") > 0)
    sums, keys = [], []
    for i, p in enumerate(params):
        if kind == "second":
            for j in range(i + 1, len(params)):
                sums.append(F.sum(F.when(F.col("s") == F.array(F.lit(i), F.lit(j)), F.col("e")).otherwise(0.0)))
                keys.append([F.lit(p).alias("param"), F.lit(params[j]).alias("param2")])
        else:
            inside = F.array_contains("s", F.lit(i)) & (F.lit(kind == "total") | (F.size("s") == 1))
            sums.append(F.sum(F.when(inside, F.col("e")).otherwise(0.0)))
            keys.append([F.lit(p).alias("param")])
    energy = rows.groupBy(*GROUP).agg(F.sum("e").alias("var"), *[s.alias(f"_e{k}") for k, s in enumerate(sums)])
    out = [
        F.struct(*k, F.when(F.col("var").isNotNull(), _share(F.col(f"_e{i}"), F.col("var"))).alias("sobol"))
        for i, k in enumerate(keys)]
    return energy.select(*GROUP, F.inline(F.array(*out)))


def evaluate_sparse(points: DataFrame, coefs: DataFrame, grid: SparseGrid) -> DataFrame:
    """``points`` (qoi, t, parameters, ...) with ``prediction``: the sparse interpolant at each point.

    The coefficients of one (qoi, t) travel as one array; a term is the product of one value per
    dimension, looked up by its degrees. An output without coefficients has a null prediction.
    """
    terms = F.sort_array(F.collect_list(F.struct("term", "coef")))
    packed = coefs.filter(F.col("coef").isNotNull()).groupBy(*GROUP).agg(terms.alias("_c"))
    met = join_group_stats(points, packed, GROUP, "left")
    top = grid.size(grid.level) - 1
    for i, m in enumerate(grid.marginals):
        met = met.withColumn(f"_v{i}", F.array(*[horner(c, standardised(m)) for c in monomials(m, top)]))

    def product(c: Column) -> Column:
        out = c["coef"]
        for i in range(len(grid.marginals)):
            out = out * F.get(F.col(f"_v{i}"), F.get(c["term"], F.lit(i)))
        return out

    value = F.aggregate("_c", F.lit(0.0), lambda total, c: total + product(c))
    return met.withColumn("prediction", value).drop("_c", *[f"_v{i}" for i in range(len(grid.marginals))])
