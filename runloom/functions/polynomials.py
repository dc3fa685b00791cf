"""Orthonormal polynomials and Gauss rules of the two supported marginals.

Only tiny one-dimensional tables are made here with numpy; all work on rows is done
by Spark with the column expressions this module returns.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marginal:
    """A varied parameter: name, closed range and distribution."""

    name: str
    lower: float
    upper: float
    dist: str = "Uniform"

    @property
    def centre(self) -> float:
        return 0.5 * (self.lower + self.upper)

    @property
    def half(self) -> float:
        return 0.5 * (self.upper - self.lower)

    @property
    def support(self) -> int:
        return int(round(self.upper - self.lower)) + 1


def recurrence(m: Marginal, order: int) -> np.ndarray:
    """beta_1..beta_order of the monic three-term recurrence in z = (x - centre) / half.

    Uniform: Legendre, k^2 / (4k^2 - 1).  DiscreteUniform on N integers: discrete
    Legendre (Gram), k^2 (N^2 - k^2) / (4 (4k^2 - 1)), rescaled to z.  alpha is 0.
    """
    k = np.arange(1, order + 1, dtype=float)
    if m.dist == "Uniform":
        return k**2 / (4 * k**2 - 1)
    if m.dist == "DiscreteUniform":
        n = m.support
        if order >= n:
            raise ValueError(f"{m.name}: order {order} needs more than {n} support points")
        return k**2 * (n**2 - k**2) / (4 * (4 * k**2 - 1)) / m.half**2
    raise ValueError(f"unknown distribution {m.dist}")


def gauss_rule(m: Marginal, order: int) -> tuple[np.ndarray, np.ndarray]:
    """order + 1 nodes in [-1, 1] and weights that sum to 1."""
    off = np.sqrt(recurrence(m, order))
    nodes, vectors = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    weights = vectors[0] ** 2
    return nodes, weights / weights.sum()


def monomials(m: Marginal, order: int) -> list[np.ndarray]:
    """Coefficients (constant first) in z of the orthonormal polynomials 0..order."""
    off = np.sqrt(recurrence(m, order)) if order else np.array([])
    polys = [np.array([1.0])]
    for k in range(order):
        nxt = np.concatenate([[0.0], polys[k]])
        if k:
            nxt[: len(polys[k - 1])] -= off[k - 1] * polys[k - 1]
        polys.append(nxt / off[k])
    return polys


def horner(coefs: np.ndarray, z: Column) -> Column:
    out = F.lit(float(coefs[-1]))
    for c in coefs[-2::-1]:
        out = out * z + F.lit(float(c))
    return out


def standardised(m: Marginal, x: Column | None = None) -> Column:
    x = F.col(m.name) if x is None else x
    return (x - F.lit(m.centre)) / F.lit(m.half)


def multi_indices(dims: int, order: int) -> list[tuple[int, ...]]:
    """All exponents of total degree <= order, constant first."""
    grid = itertools.product(range(order + 1), repeat=dims)
    return sorted((a for a in grid if sum(a) <= order), key=lambda a: (sum(a), tuple(-v for v in a)))


def basis_columns(marginals: list[Marginal], order: int) -> list[Column]:
    """phi_a(x) of every multi index, as expressions over the parameter columns."""
    one_d = {
        m.name: [horner(c, standardised(m)) for c in monomials(m, order)] for m in marginals
    }
    out = []
    for a in multi_indices(len(marginals), order):
        term = F.lit(1.0)
        for m, k in zip(marginals, a):
            if k:
                term = term * one_d[m.name][k]
        out.append(term)
    return out


def basis_values(marginals: list[Marginal], order: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """phi (rows, terms) and its gradient (rows, dims, terms) for a batch inside a task."""
    z = (x - [m.centre for m in marginals]) / [m.half for m in marginals]
    value, slope = [], []
    for i, m in enumerate(marginals):
        polys = monomials(m, order)
        value.append(np.stack([np.polyval(c[::-1], z[:, i]) for c in polys], axis=1))
        slope.append(
            np.stack([np.polyval(np.polyder(c[::-1]), z[:, i]) / m.half for c in polys], axis=1)
        )
    index = multi_indices(len(marginals), order)
    phi = np.ones((len(x), len(index)))
    grad = np.ones((len(x), len(marginals), len(index)))
    for t, a in enumerate(index):
        for i, k in enumerate(a):
            phi[:, t] *= value[i][:, k]
            for j in range(len(marginals)):
                grad[:, j, t] *= slope[i][:, k] if i == j else value[i][:, k]
    return phi, grad
