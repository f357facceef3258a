"""Polynomial interpolation on the driver, and its evaluation as a column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lagrange(x: list[float], y: list[float]) -> np.ndarray:
    """Coefficients, from the constant up, of the polynomial through the points."""
    out = np.zeros(len(x))
    for i, (xi, yi) in enumerate(zip(x, y)):
        basis = np.array([1.0])
        for j, xj in enumerate(x):
            if j != i:
                basis = np.convolve(basis, [-xj, 1.0]) / (xi - xj)
        out[: len(basis)] += yi * basis
    return out


def newton(x: list[float], y: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, divided differences)."""
    table = np.array(y, float)
    nodes = np.array(x, float)
    for k in range(1, len(nodes)):
        table[k:] = (table[k:] - table[k - 1 : -1]) / (nodes[k:] - nodes[:-k])
    return nodes, table


def newton_value(nodes: np.ndarray, differences: np.ndarray, x: float) -> float:
    out = 0.0
    for node, d in zip(nodes[::-1], differences[::-1]):
        out = out * (x - node) + d
    return out


def value(coefficients, x: Column) -> Column:
    """Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(list(coefficients)):
        out = out * x + float(c)
    return out
