"""Experimental designs: tables with one row per run.

Every design hangs on a table of campaigns (or of ids): one row per campaign with a
``<name>_lower`` and ``<name>_upper`` column per parameter. Rows of all campaigns are
generated in one pass by index arithmetic on literal one-dimensional rules, without a
join or a shuffle, and run ids never depend on partitioning.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import inverse_discrete_uniform, inverse_uniform, unit_hash
from ..functions.polynomials import Marginal, gauss_rule
from ..functions.vectors import doubles

# Degree, coefficient and initial numbers of the primitive polynomials of
# the Sobol sequence, dimensions 2 to 12 (dimension 1 is the van der Corput sequence).
SOBOL_DIRECTIONS = [
    (1, 0, [1]),
    (2, 1, [1, 3]),
    (3, 1, [1, 3, 1]),
    (3, 2, [1, 1, 1]),
    (4, 1, [1, 1, 3, 3]),
    (4, 4, [1, 3, 5, 13]),
    (5, 2, [1, 1, 5, 5, 17]),
    (5, 4, [1, 1, 5, 5, 5]),
    (5, 7, [1, 1, 7, 11, 19]),
    (5, 11, [1, 1, 5, 1, 1]),
    (5, 13, [1, 1, 1, 3, 11]),
]
# A double holds points of 52 bits; an index beyond is an error.
SOBOL_BITS = 52
# Runs that one generated row grows into; larger grids are dealt out in blocks of runs.
GRID_BLOCK = 4096


def campaign_row(spark: SparkSession, marginals: list[Marginal], campaign: str = "campaign") -> DataFrame:
    """The campaign table of a single campaign with known ranges."""
    values = {"campaign": campaign}
    for m in marginals:
        values[f"{m.name}_lower"], values[f"{m.name}_upper"] = float(m.lower), float(m.upper)
    return spark.createDataFrame([tuple(values.values())], list(values))


def _bounds(m: Marginal) -> tuple[Column, Column]:
    return F.col(f"{m.name}_lower"), F.col(f"{m.name}_upper")


def _scaled(m: Marginal, z: Column) -> Column:
    lower, upper = _bounds(m)
    return lower + (z + 1.0) * 0.5 * (upper - lower)


def _without_bounds(df: DataFrame, marginals: list[Marginal]) -> DataFrame:
    return df.drop(*[f"{m.name}_{s}" for m in marginals for s in ("lower", "upper")])


def tensor_design(campaigns: DataFrame, marginals: list[Marginal], order: int, levels: list[int] | None = None) -> DataFrame:
    """Full tensor Gauss grid: (order + 1)^d runs per campaign with product weights.

    ``levels`` gives another number of nodes minus one per dimension. A marginal's own
    range fixes the shape of a DiscreteUniform rule; its nodes are scaled to each
    campaign's range.
    """
    levels = levels or [order] * len(marginals)
    total = math.prod(n + 1 for n in levels)
    keys = [c for c in campaigns.columns if not c.endswith(("_lower", "_upper"))]
    df = _numbered_runs(campaigns, keys, total)
    weight, digits, stride = F.lit(1.0), [], 1
    for m, n in reversed(list(zip(marginals, levels))):
        nodes, weights = gauss_rule(m, n)
        digit = F.floor(F.col("run_id") / F.lit(float(stride))).cast("int") % (n + 1)
        digits.insert(0, digit)
        df = df.withColumn(m.name, _scaled(m, F.get(doubles(nodes), digit)))
        weight = weight * F.get(doubles(weights), digit)
        stride *= n + 1
    df = df.withColumn("node_idx", F.array(*digits)).withColumn("weight", weight)
    return _without_bounds(df, marginals)


def _numbered_runs(campaigns: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``total`` rows per campaign with ``run_id``; a large grid is spread over tasks before it is made."""
    first = F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"), F.lit(GRID_BLOCK).cast("long"))
    blocks = campaigns.withColumn("_first", F.explode(first))
    if total > GRID_BLOCK:
        blocks = blocks.repartition(*keys, "_first")
    last = F.least(F.col("_first") + (GRID_BLOCK - 1), F.lit(total - 1).cast("long"))
    return blocks.withColumn("run_id", F.explode(F.sequence(F.col("_first"), last))).drop("_first")


def level_size(level: int, growth: bool) -> int:
    """Points of the one-dimensional rule of a level."""
    return 2**level - 1 if growth else level


def combination(dims: int, level: int) -> list[tuple[tuple[int, ...], int]]:
    """The tensors of the Smolyak combination: levels from 1 per dimension, and the signed coefficient.

    Only levels that add up to ``level`` ... ``level + dims - 1`` are made, by placing what
    exceeds 1 dimension by dimension.
    """
    def place(left: int, most: int) -> list[tuple[int, ...]]:
        if left == 0:
            return [()]
        return [(1 + extra, *rest) for extra in range(most + 1) for rest in place(left - 1, most - extra)]

    out = []
    for ls in place(dims, level - 1):
        gap = level + dims - 1 - sum(ls)
        if gap <= dims - 1:
            out.append((ls, (-1) ** gap * math.comb(dims - 1, gap)))
    return out


def sparse_nodes(marginals: list[Marginal], level: int, growth: bool = False) -> dict[tuple[float, ...], float]:
    """Standardised nodes of the Smolyak combination with their summed weights.

    The grid does not depend on the ranges, so nodes are merged here, rounded on [-1, 1].
    """
    nodes: dict[tuple[float, ...], float] = {}
    for ls, coef in combination(len(marginals), level):
        rules = [gauss_rule(m, level_size(n, growth) - 1) for m, n in zip(marginals, ls)]
        for point in itertools.product(*[range(len(z)) for z, _ in rules]):
            key = tuple(round(float(z[i]), 12) + 0.0 for (z, _), i in zip(rules, point))
            nodes[key] = nodes.get(key, 0.0) + coef * math.prod(float(w[i]) for (_, w), i in zip(rules, point))
    return nodes


def sparse_design(campaigns: DataFrame, marginals: list[Marginal], level: int, growth: bool = False) -> DataFrame:
    """Smolyak combination of tensor grids; the first level has one point.

    A level-l rule has l points, or 2^l - 1 with ``growth``. Equal nodes of different
    tensors are merged by adding their weights (which may be negative), whatever the ranges.
    """
    nodes = sparse_nodes(marginals, level, growth)
    # One literal table, the same for all campaigns: (z_1, ..., z_d, weight) per node.
    table = json.dumps([[*z, w] for z, w in nodes.items()])
    numbered = _numbered_runs(campaigns, [c for c in campaigns.columns if not c.endswith(("_lower", "_upper"))], len(nodes))
    df = numbered.withColumn("_node", F.get(F.from_json(F.lit(table), "array<array<double>>"), F.col("run_id").cast("int")))
    for i, m in enumerate(marginals):
        df = df.withColumn(m.name, _scaled(m, F.get("_node", F.lit(i))))
    df = df.withColumn("weight", F.get("_node", F.lit(len(marginals))))
    return _without_bounds(df.drop("_node", "run_id"), marginals)


def random_design(ids: DataFrame, id_col: str, marginals: list[Marginal], seed: int) -> DataFrame:
    """One random run per row of ``ids``, reproducible at any partitioning.

    ``ids`` carries the ``<name>_lower/upper`` columns, or the marginals' own ranges are used.
    """
    out = ids
    for m in marginals:
        has = f"{m.name}_lower" in ids.columns
        lower, upper = _bounds(m) if has else (F.lit(float(m.lower)), F.lit(float(m.upper)))
        inverse = inverse_uniform if m.dist == "Uniform" else inverse_discrete_uniform
        out = out.withColumn(m.name, inverse(unit_hash(seed, m.name, id_col), lower, upper))
    return _without_bounds(out, marginals)


def fresh_sample(runs: DataFrame, marginals: list[Marginal], seed: int, factor: int = 100) -> DataFrame:
    """A new Monte Carlo sample with ``factor`` rows per run of the design.

    Rows hang on the design's run ids, so the sample is made where the runs are.
    """
    # The run ids are few and the sample is large: spread the ids over all cores first.
    cores = runs.sparkSession.sparkContext.defaultParallelism
    ids = runs.select("run_id").repartition(cores, "run_id")
    ids = ids.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    ids = ids.select((F.col("run_id") * factor + F.col("copy")).alias("sample_id"))
    return random_design(ids, "sample_id", marginals, seed)


def _is_primitive(poly: int, degree: int) -> bool:
    """Whether a polynomial over GF(2), given by its bits, is primitive: x has order 2^degree - 1."""
    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a <<= 1
            a ^= poly if a >> degree & 1 else 0
            b >>= 1
        return out

    def power(n: int) -> int:
        out, base = 1, 2 if degree > 1 else 2 ^ poly
        while n:
            out = times(out, base) if n & 1 else out
            base, n = times(base, base), n >> 1
        return out

    order = (1 << degree) - 1
    primes, n, p = set(), order, 2
    while p * p <= n:
        while n % p == 0:
            primes.add(p)
            n //= p
        p += 1
    primes |= {n} if n > 1 else set()
    return power(order) == 1 and all(power(order // q) != 1 for q in primes)


@functools.cache
def sobol_direction(dim: int) -> tuple[int, int, list[int]]:
    """Degree, inner coefficients and initial odd numbers of a dimension (1-based after the first).

    Beyond the published numbers above, primitive polynomials are taken in order of degree
    and value, and initial numbers are drawn from a hash.
    """
    if dim <= len(SOBOL_DIRECTIONS):
        return SOBOL_DIRECTIONS[dim - 1]
    left, degree = dim, 0
    while True:
        degree += 1
        for coef in range(1 << max(0, degree - 1)):
            poly = (1 << degree) | (coef << 1) | 1
            if _is_primitive(poly, degree):
                left -= 1
                if left == 0:
                    draw = [int(hashlib.md5(f"{dim}:{i}".encode()).hexdigest()[:8], 16) for i in range(degree)]
                    return degree, coef, [(d % (1 << i)) * 2 + 1 for i, d in enumerate(draw)]


def sobol_vectors(dim: int) -> list[int]:
    """Direction numbers of one dimension (0-based) from the recurrence."""
    if dim == 0:
        return [1 << (SOBOL_BITS - 1 - i) for i in range(SOBOL_BITS)]
    degree, coef, initial = sobol_direction(dim)
    v = [m << (SOBOL_BITS - 1 - i) for i, m in enumerate(initial)]
    for i in range(degree, SOBOL_BITS):
        new = v[i - degree] ^ (v[i - degree] >> degree)
        for k in range(1, degree):
            if coef >> (degree - 1 - k) & 1:
                new ^= v[i - k]
        v.append(new)
    return v


def sobol_point(index: Column, dim: int) -> Column:
    """Coordinate ``dim`` of point ``index`` (natural order) in [0, 1)."""
    bits = F.array(*[F.lit(v).cast("long") for v in sobol_vectors(dim)])
    places = F.sequence(F.lit(0), F.lit(SOBOL_BITS - 1))
    index = index.cast("long")
    picked = F.zip_with(
        bits, places,
        lambda v, i: F.when(F.call_function("shiftright", index, i).bitwiseAND(F.lit(1).cast("long")) == 1, v).otherwise(F.lit(0).cast("long")),
    )
    mixed = F.aggregate(picked, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))
    inside = (index >= 0) & (index < F.lit(1 << SOBOL_BITS))
    return F.when(inside | index.isNull(), mixed / F.lit(float(2**SOBOL_BITS))).otherwise(
        F.raise_error(F.concat(F.lit("index beyond the Sobol sequence: "), index.cast("string"))).cast("double"))


def quasi_random_design(
    bases: DataFrame, base_col: str, marginals: list[Marginal], skip: int = 2, second_order: bool = False
) -> DataFrame:
    """Sobol-point blocks A, B and AB_i (A with column i of B): d + 2 runs per base point.

    The first ``skip`` points of the sequence are left out. One point has 2d
    coordinates: the first d make A, the others B. ``second_order`` adds the blocks BA_i
    (B with column i of A), 2d + 2 runs per base point in all.
    """
    d = len(marginals)
    index = F.col(base_col) + F.lit(skip)
    df = bases
    for i in range(2 * d):
        df = df.withColumn(f"_u{i}", sobol_point(index, i))
    names = ["A", "B", *[f"AB_{m.name}" for m in marginals], *[f"BA_{m.name}" for m in marginals if second_order]]
    df = df.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    df = df.withColumn("block", F.get(F.array(*[F.lit(n) for n in names]), F.col("_b")))
    for i, m in enumerate(marginals):
        of_b = (F.col("_b") == 1) | (F.col("_b") == i + 2) | ((F.col("_b") > d + 1) & (F.col("_b") != d + 2 + i))
        u = F.when(of_b, F.col(f"_u{d + i}")).otherwise(F.col(f"_u{i}"))
        inverse = inverse_uniform if m.dist == "Uniform" else inverse_discrete_uniform
        df = df.withColumn(m.name, inverse(u, F.lit(float(m.lower)), F.lit(float(m.upper))))
    df = df.withColumn("run_id", F.col(base_col) * len(names) + F.col("_b"))
    return df.drop("_b", *[f"_u{i}" for i in range(2 * d)])
