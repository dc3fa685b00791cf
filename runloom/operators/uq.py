"""Moments and Sobol indices per quantity of interest and time index.

All functions take the long collated table and group by its (qoi, t), so any number of
QoIs and time steps is one pass. Sums are pre-aggregated on the map side; nothing is
held per group but a fixed number of sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_group_stats
from ..functions.polynomials import Marginal, basis_columns, multi_indices
from ..functions.quantiles import exact_quantiles, weighted_quantiles
from ..functions.vectors import dot, weighted_sum
from ..functions.workspace import materialise

GROUP = ["qoi", "t"]
# Beyond this many terms the projection is a grouped sum over exploded terms.
MAX_SUMS = 128


class NoSobolAnalysis(ValueError):
    """A purely random design has moments but no Sobol indices."""


def describe(collated: DataFrame, quantiles: bool = True) -> DataFrame:
    """Mean, population variance, std, min, max and 10 % / 90 % quantiles."""
    out = collated.groupBy(*GROUP).agg(
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n"),
    )
    if not quantiles:
        return out
    return out.join(exact_quantiles(collated, GROUP, "value", {"p10": 0.1, "p90": 0.9}), GROUP)


def weighted_describe(collated: DataFrame) -> DataFrame:
    """``describe`` of a quadrature design: every statistic by the runs' weights, which may be negative.

    A quantile is the least value up to which the cumulated weight reaches its share of the sum;
    rows of weight 0 count for min and max only. A sparse rule's negative weights can give a
    variance below 0, which is kept, and a null standard deviation.
    """
    ranges = collated.groupBy(*GROUP).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("weight").alias("weight_sum"))
    quantiles = weighted_quantiles(collated, GROUP, "value", "weight", {"p10": 0.1, "p90": 0.9})
    moments = weighted_moments(collated).withColumn("std", F.when(F.col("var") >= 0, F.sqrt("var")))
    return moments.join(ranges, GROUP).join(quantiles, GROUP).select(
        *GROUP, "mean", "var", "std", "min", "max", F.col("n_nodes").alias("n"), "weight_sum", "p10", "p90")


def histogram(collated: DataFrame, bins: int = 50) -> DataFrame:
    """Density histogram between the least and largest value of each (qoi, t)."""
    ranges = collated.groupBy(*GROUP).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("total")
    )
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0 / bins))
    placed = join_group_stats(collated, ranges, GROUP).withColumn("width", width).withColumn(
        "bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("long")
    )
    return (
        placed.groupBy(*GROUP, "bin", "lo", "width", "total")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *GROUP, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"), "count",
            (F.col("count") / (F.col("total") * F.col("width"))).alias("density"),
        )
    )


# --- polynomial chaos -------------------------------------------------------------


def pce_coefficients(collated: DataFrame, marginals: list[Marginal], order: int) -> DataFrame:
    """Pseudo-spectral projection: (qoi, t, coefs) with coefs ordered by multi index.

    Coefficient a is the sum of weight * value * phi_a(parameters). Weights are divided
    by their sum, so a design with missing nodes is renormalised over the present ones;
    ``weight_sum`` and ``n_runs`` report it.
    """
    terms = len(multi_indices(len(marginals), order))
    weighted = collated.withColumn("_wf", F.col("weight") * F.col("value"))
    common = [F.sum("weight").alias("weight_sum"), F.count(F.lit(1)).alias("n_runs")]
    if terms <= MAX_SUMS:
        sums = [F.sum(F.col("_wf") * phi).alias(f"_c{i}") for i, phi in enumerate(basis_columns(marginals, order))]
        grouped = weighted.groupBy(*GROUP).agg(*common, *sums)
        coefs = F.array(*[F.col(f"_c{i}") / F.col("weight_sum") for i in range(terms)])
        return grouped.select(*GROUP, coefs.alias("coefs"), "weight_sum", "n_runs")
    phi = F.array(*basis_columns(marginals, order))
    per_term = (
        weighted.select(*GROUP, "weight", "_wf", F.posexplode(phi).alias("a", "phi"))
        .groupBy(*GROUP, "a")
        .agg(F.sum(F.col("_wf") * F.col("phi")).alias("c"), *common)
    )
    ordered = F.sort_array(F.collect_list(F.struct("a", (F.col("c") / F.col("weight_sum")).alias("c"))))
    return per_term.groupBy(*GROUP).agg(
        F.transform(ordered, lambda p: p["c"]).alias("coefs"),
        F.first("weight_sum").alias("weight_sum"),
        F.first("n_runs").alias("n_runs"),
    )


def coefficient_rows(coefs: DataFrame, marginals: list[Marginal], order: int) -> DataFrame:
    """(qoi, t, term, coef) with term written as exponents, for example ``1-0``."""
    names = F.array(*[F.lit("-".join(map(str, a))) for a in multi_indices(len(marginals), order)])
    return coefs.select(*GROUP, F.posexplode("coefs").alias("_a", "coef")).select(
        *GROUP, F.get(names, F.col("_a")).alias("term"), "coef"
    )


def _energy(index: list[tuple[int, ...]], keep) -> Column:
    total = F.lit(0.0)
    for i, a in enumerate(index):
        if keep({d for d, k in enumerate(a) if k}):
            total = total + F.get("coefs", F.lit(i)) * F.get("coefs", F.lit(i))
    return total


def pce_moments(coefs: DataFrame, marginals: list[Marginal], order: int) -> DataFrame:
    index = multi_indices(len(marginals), order)
    var = _energy(index, bool)
    return coefs.select(*GROUP, F.get("coefs", F.lit(0)).alias("mean"), var.alias("var"), F.sqrt(var).alias("std"))


def _share(energy: Column, var: Column) -> Column:
    """Index, 0 where the output does not vary."""
    return F.coalesce(F.try_divide(energy, var), F.lit(0.0))


def pce_sobol(coefs: DataFrame, marginals: list[Marginal], order: int, kind: str) -> DataFrame:
    """Sobol indices ``first``, ``total`` or ``second`` from the coefficients.

    first / total: (qoi, t, param, sobol); second: (qoi, t, param, param2, sobol).
    """
    index = multi_indices(len(marginals), order)
    var = _energy(index, bool)
    names = [m.name for m in marginals]
    rows = []
    for i, n in enumerate(names):
        if kind == "first":
            e = _energy(index, lambda s, i=i: s == {i})
        elif kind == "total":
            e = _energy(index, lambda s, i=i: i in s)
        else:
            for j in range(i + 1, len(names)):
                e = _energy(index, lambda s, i=i, j=j: s == {i, j})
                rows.append(F.struct(F.lit(n).alias("param"), F.lit(names[j]).alias("param2"), _share(e, var).alias("sobol")))
            continue
        rows.append(F.struct(F.lit(n).alias("param"), _share(e, var).alias("sobol")))
    return coefs.select(*GROUP, F.inline(F.array(*rows)))


def evaluate_pce(points: DataFrame, coefs: DataFrame, marginals: list[Marginal], order: int) -> DataFrame:
    """Prediction at rows that carry (qoi, t) and the parameters."""
    phi = basis_columns(marginals, order)
    joined = join_group_stats(points, coefs.select(*GROUP, "coefs"), GROUP)
    value = weighted_sum("coefs", phi) if len(phi) <= MAX_SUMS else dot(F.col("coefs"), F.array(*phi))
    return joined.withColumn("prediction", value).drop("coefs")


# --- stochastic collocation on a tensor grid ---------------------------------------


def weighted_moments(collated: DataFrame) -> DataFrame:
    """Weighted mean, variance and std per (qoi, t); the variance is taken about the mean."""
    mean = collated.groupBy(*GROUP).agg(
        (F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("mean"), F.count(F.lit(1)).alias("n_nodes")
    )
    gap = F.col("value") - F.col("mean")
    return (
        join_group_stats(collated, mean, GROUP)
        .groupBy(*GROUP)
        .agg(
            F.first("mean").alias("mean"),
            (F.sum(F.col("weight") * gap * gap) / F.sum("weight")).alias("var"),
            F.first("n_nodes").alias("n_nodes"),
        )
        .withColumn("std", F.sqrt("var"))
    )


def sc_first_order(collated: DataFrame, params: list[str], moments: DataFrame | None = None) -> DataFrame:
    """First-order index: variance of the conditional mean given a parameter's node.

    The d conditional tables are one grouping over (param, node), combined map-side.
    """
    entries = F.inline(
        F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("node")) for p in params])
    )
    conditional = (
        collated.select(*GROUP, "weight", "value", entries)
        .groupBy(*GROUP, "param", "node")
        .agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("value")).alias("wf"))
    )
    moments = weighted_moments(collated) if moments is None else moments
    gap = F.col("wf") / F.col("w") - F.col("mean")
    return (
        conditional.join(moments.select(*GROUP, "mean", "var"), GROUP)
        .groupBy(*GROUP, "param")
        .agg((F.sum(F.col("w") * gap * gap) / F.sum("w")).alias("_e"), F.first("var").alias("_v"))
        .select(*GROUP, "param", _share(F.col("_e"), F.col("_v")).alias("sobol"))
    )


def _closed_variances(collated: DataFrame, params: list[str], subsets: list[tuple[str, ...]]) -> DataFrame:
    """(qoi, t, subset, closed): variance of the conditional mean given the nodes of each subset of parameters.

    All subsets are one grouping: a row is repeated per subset with the nodes of its parameters
    and nothing in the other places, and reduced on the map side. ``subset`` is the place in
    the list. Weights are divided by their sum, so missing nodes are renormalised away.
    """
    entries = F.inline(F.array(*[
        F.struct(
            F.lit(k).alias("subset"),
            F.array(*[F.col(p).cast("double") if p in s else F.lit(None).cast("double") for p in params]).alias("nodes"))
        for k, s in enumerate(subsets)]))
    conditional = (
        collated.select(*GROUP, "weight", "value", entries)
        .groupBy(*GROUP, "subset", "nodes")
        .agg(F.sum("weight").alias("w"), (F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("m"))
    )
    mean = conditional.groupBy(*GROUP, "subset").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mean"))
    gap = F.col("m") - F.col("mean")
    return join_group_stats(conditional, mean, [*GROUP, "subset"]).groupBy(*GROUP, "subset").agg(
        (F.sum(F.col("w") * gap * gap) / F.sum("w")).alias("closed"))


def sc_sobol(
    collated: DataFrame, params: list[str], kind: str, moments: DataFrame | None = None, designed: int | None = None
) -> DataFrame:
    """Sobol indices ``first``, ``total`` or ``second`` of a collocation design.

    The variance of a set of parameters is found by inclusion and exclusion from closed
    variances D (of conditional means): second = (D_ij - D_i - D_j) / V, and total = (V - D of
    all others) / V, the sum over all sets with the parameter. first / total: (qoi, t, param,
    sobol); second: (qoi, t, param, param2, sobol). With ``designed``, the design's number of
    nodes, ``n_missing`` says how many of them an output lacks.
    """
    pairs = [(a, b) for i, a in enumerate(params) for b in params[i + 1:]]
    moments = weighted_moments(collated) if moments is None else moments
    if kind == "second":
        subsets = [*[(p,) for p in params], *pairs]
        rows = [(len(params) + k, a, b, [(len(params) + k, 1.0), (params.index(a), -1.0), (params.index(b), -1.0)])
                for k, (a, b) in enumerate(pairs)]
    elif kind in ("first", "total"):
        subsets = [(p,) if kind == "first" else tuple(o for o in params if o != p) for p in params]
        rows = [(k, p, None, [(k, 1.0 if kind == "first" else -1.0)]) for k, p in enumerate(params)]
    else:
        raise ValueError(f"unknown kind of index {kind}")
    closed = _closed_variances(collated, params, subsets).groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("subset") == k, F.col("closed"))).alias(f"_d{k}") for k in range(len(subsets))])
    out = []
    for _, a, b, terms in rows:
        energy = F.col("var") if kind == "total" else F.lit(0.0)
        for k, sign in terms:
            energy = energy + F.lit(sign) * F.col(f"_d{k}")
        second = [F.lit(b).alias("param2")] if b else []
        out.append(F.struct(F.lit(a).alias("param"), *second, _share(energy, F.col("var")).alias("sobol")))
    if not out:
        return closed.select(*GROUP, F.lit("").alias("param"), F.lit("").alias("param2"), F.lit(0.0).alias("sobol")).limit(0)
    missing = [] if designed is None else [(F.lit(designed) - F.col("n_nodes")).cast("long").alias("n_missing")]
    return closed.join(moments, GROUP).select(*GROUP, *missing, F.inline(F.array(*out)))


def missing_nodes(collated: DataFrame, expected: int) -> DataFrame:
    """(qoi, t, n_missing) against the full tensor size."""
    return collated.groupBy(*GROUP).agg((F.lit(expected) - F.count(F.lit(1))).cast("long").alias("n_missing"))


def _lagrange(x: Column, nodes: list[float]) -> Column:
    """Values at ``x`` of the polynomials that are 1 at one node and 0 at the others."""
    out = []
    for j, at in enumerate(nodes):
        term = F.lit(1.0)
        for k, other in enumerate(nodes):
            if k != j:
                term = term * (x - other) / F.lit(float(at - other))
        out.append(term)
    return F.array(*out)


def evaluate_sc(points: DataFrame, collated: DataFrame, names: list[str], nodes: list[list[float]]) -> DataFrame:
    """``points`` with ``prediction``: the tensor interpolation of the outputs at the grid's nodes.

    ``points`` has (qoi, t) and the parameters; ``collated`` the outputs at every node;
    ``nodes`` the values of each parameter in order. Each (qoi, t) has one array over the
    grid; one that lacks a node has a null prediction.
    """
    place, total = F.lit(0), 1
    for n, values in zip(names, nodes):
        place = place * len(values) + F.array_position(F.array(*[F.lit(float(v)) for v in values]), F.col(n).cast("double")) - 1
        total *= len(values)
    entries = F.sort_array(F.collect_list(F.struct(place.cast("long").alias("at"), F.col("value").cast("double").alias("v"))))
    packed = collated.groupBy(*GROUP).agg(F.transform(entries, lambda e: e["v"]).alias("_f"))
    def products(so_far: Column, own: Column) -> Column:
        return F.flatten(F.transform(so_far, lambda a: F.transform(own, lambda b: a * b)))

    weights = F.array(F.lit(1.0))
    for n, values in zip(names, nodes):
        weights = products(weights, _lagrange(F.col(n), values))
    met = join_group_stats(points, packed, GROUP).withColumn("_w", weights)
    value = F.aggregate(F.zip_with("_w", "_f", lambda w, f: w * f), F.lit(0.0), lambda s, x: s + x)
    return met.withColumn("prediction", F.when(F.size("_f") == total, value)).drop("_w", "_f")


# --- quasi Monte Carlo --------------------------------------------------------------


def qmc_blocks(outputs: DataFrame, params: list[str]) -> DataFrame:
    """One row per (qoi, t, base) with the outputs of blocks A, B and every AB_i."""
    picks = [
        F.max(F.when(F.col("block") == b, F.col("value"))).alias(f"f_{b}")
        for b in ["A", "B", *[f"AB_{p}" for p in params]]
    ]
    return outputs.groupBy(*GROUP, "base").agg(*picks)


def qmc_second_order(outputs: DataFrame, params: list[str], designed: int | None = None) -> DataFrame:
    """Second-order indices of a design with B-in-A and A-in-B blocks (``second_order=True``).

    Blocks BA_i and AB_j share the i-th column of A and the j-th of B, so the mean of their
    product estimates the closed variance of the pair; the first-order parts are taken off.
    Averages run over the ``n_bases`` bases that are complete in all 2 d + 2 blocks.
    """
    names = ["A", "B", *[f"AB_{p}" for p in params], *[f"BA_{p}" for p in params]]
    blocks = outputs.groupBy(*GROUP, "base").agg(
        *[F.max(F.when(F.col("block") == b, F.col("value"))).alias(f"f_{b}") for b in names])
    whole = F.lit(True)
    for b in names:
        whole = whole & F.col(f"f_{b}").isNotNull()
    counts = blocks.groupBy(*GROUP).agg(F.count_if(whole).alias("n_bases"), F.count(F.lit(1)).alias("_seen")).select(
        *GROUP, "n_bases", ((F.col("_seen") if designed is None else F.lit(designed)) - F.col("n_bases")).alias("n_incomplete"))
    pairs = [(a, b) for i, a in enumerate(params) for b in params[i + 1:]]
    a, b = F.col("f_A"), F.col("f_B")
    sums = blocks.filter(whole).groupBy(*GROUP).agg(
        F.avg("f_A").alias("_ma"), F.avg("f_B").alias("_mb"), F.var_pop("f_A").alias("_va"), F.var_pop("f_B").alias("_vb"),
        *[F.avg(b * (F.col(f"f_AB_{p}") - a)).alias(f"_s_{p}") for p in params],
        *[F.avg(F.col(f"f_BA_{p}") * F.col(f"f_AB_{q}") - a * b).alias(f"_p_{p}_{q}") for p, q in pairs])
    var = (F.col("_va") + F.col("_vb")) / 2.0 + F.pow((F.col("_ma") - F.col("_mb")) / 2.0, F.lit(2.0))
    rows = F.array(*[
        F.struct(
            F.lit(p).alias("param"), F.lit(q).alias("param2"),
            F.when(F.col("n_bases") > 0, _share(
                F.col(f"_p_{p}_{q}") - F.col(f"_s_{p}") - F.col(f"_s_{q}"), F.col("var"))).alias("sobol_second"))
        for p, q in pairs])
    return counts.join(sums.withColumn("var", var), GROUP, "left").select(*GROUP, "n_bases", "n_incomplete", F.inline(rows))


def qmc_sobol(outputs: DataFrame, params: list[str], designed: int | None = None) -> DataFrame:
    """Saltelli first-order and Jansen total indices with mean and variance of A and B.

    Only bases with an output in every block count, so all averages run over the same
    bases: ``n_bases`` of them. ``n_incomplete`` counts the others, also those without any
    output if ``designed`` says how many bases the design has.
    """
    blocks = qmc_blocks(outputs, params)
    whole = F.lit(True)
    for b in ["A", "B", *[f"AB_{p}" for p in params]]:
        whole = whole & F.col(f"f_{b}").isNotNull()
    counts = blocks.groupBy(*GROUP).agg(
        F.count_if(whole).alias("n_bases"), F.count(F.lit(1)).alias("_seen")
    ).select(*GROUP, "n_bases", ((F.col("_seen") if designed is None else F.lit(designed)) - F.col("n_bases")).alias("n_incomplete"))
    blocks = blocks.filter(whole)
    aggs = []
    for p in params:
        ab = F.col(f"f_AB_{p}")
        aggs.append(F.avg(F.col("f_B") * (ab - F.col("f_A"))).alias(f"_s_{p}"))
        aggs.append((F.avg((F.col("f_A") - ab) * (F.col("f_A") - ab)) / 2.0).alias(f"_t_{p}"))
    # Mean and variance of the 2n independent outputs from the moments of both halves.
    halves = blocks.groupBy(*GROUP).agg(
        F.avg("f_A").alias("_ma"), F.avg("f_B").alias("_mb"),
        F.var_pop("f_A").alias("_va"), F.var_pop("f_B").alias("_vb"), *aggs,
    )
    var = (F.col("_va") + F.col("_vb")) / 2.0 + F.pow((F.col("_ma") - F.col("_mb")) / 2.0, F.lit(2.0))
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("param"),
                F.when(F.col("n_bases") > 0, _share(F.col(f"_s_{p}"), F.col("var"))).alias("sobol_first"),
                F.when(F.col("n_bases") > 0, _share(F.col(f"_t_{p}"), F.col("var"))).alias("sobol_total"),
            )
            for p in params
        ]
    )
    return counts.join(halves.withColumn("var", var), GROUP, "left").select(
        *GROUP, "n_bases", "n_incomplete", ((F.col("_ma") + F.col("_mb")) / 2.0).alias("mean"), "var", F.inline(rows)
    )


# --- report tables ------------------------------------------------------------------


def moment_band(moments: DataFrame) -> DataFrame:
    return moments.select(
        *GROUP, "mean", (F.col("mean") - F.col("std")).alias("lower"), (F.col("mean") + F.col("std")).alias("upper")
    )


def index_curves(moments: DataFrame, indices: DataFrame) -> DataFrame:
    """Index against mean QoI over time, per parameter (or pair)."""
    return moments.select(*GROUP, "mean").join(indices, GROUP)


def analyse(collated: DataFrame, marginals: list[Marginal], sampler: str, order: int = 3) -> dict[str, DataFrame]:
    """All result tables of a campaign, by the kind of its design.

    ``collated`` is read more than once, so it should be a stored table.
    """
    names = [m.name for m in marginals]
    if sampler == "random":
        return {"moments": describe(collated)}
    if sampler == "pce":
        coefs = materialise(pce_coefficients(collated, marginals, order), "coefs")
        out = {"moments": pce_moments(coefs, marginals, order)}
        for kind in ("first", "total", "second"):
            out[f"sobol_{kind}"] = pce_sobol(coefs, marginals, order, kind)
        return out
    if sampler == "sc":
        moments = materialise(weighted_moments(collated), "moments")
        out = {"moments": moments, "sobol_first": sc_first_order(collated, names, moments)}
        for kind in ("total", "second"):
            out[f"sobol_{kind}"] = sc_sobol(collated, names, kind, moments)
        return out
    if sampler == "qmc":
        return {"sobol": qmc_sobol(collated, names)}
    raise ValueError(f"unknown sampler {sampler}")


def sobol_indices(collated: DataFrame, marginals: list[Marginal], sampler: str, order: int = 3) -> DataFrame:
    """First-order indices; a random design has none and raises."""
    if sampler == "random":
        raise NoSobolAnalysis("a random design has no Sobol analysis; use describe()")
    tables = analyse(collated, marginals, sampler, order)
    return tables.get("sobol_first", tables.get("sobol"))


