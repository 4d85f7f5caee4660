"""Distribution tails and linkage in NumPy and the standard library."""

from __future__ import annotations

from functools import cache
from math import comb, exp, inf, lgamma, log, log1p, pi, sqrt

import numpy as np


def chi2_log_sf(x: float, df: int) -> float:
    """log of P(chi-squared with df degrees > x), accurate far into the tail."""
    if not x > 0:
        return 0.0 if x == x else float("nan")
    a, z = df / 2, x / 2
    head = a * log(z) - z - lgamma(a)
    if z < a + 1:  # series for the lower part
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= z / k
            total += term
        return log1p(-min(exp(head) * total, 1 - 1e-16))
    # continued fraction for the upper part, by Lentz's method
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        change = d * c
        h *= change
        if abs(change - 1) < 1e-16:
            break
    return head + log(h)


def chi2_sf(x: float, df: int) -> float:
    return exp(chi2_log_sf(x, df)) if x == x else 1.0


@cache
def _normal() -> tuple[np.ndarray, ...]:
    """Points with the normal density, and a finer grid with the distribution."""
    from statistics import NormalDist

    z, grid = np.linspace(-9, 9, 6001), np.linspace(-12, 9, 8401)
    return z, np.exp(-z * z / 2) / sqrt(2 * pi), grid, np.array([NormalDist().cdf(float(v)) for v in grid])


def studentised_range_sf(q: float, k: int) -> float:
    """P(range of k standard normals > q), by numerical integration."""
    if q <= 0 or k < 2:
        return 1.0
    z, phi, grid, cdf = _normal()
    inside = np.interp(z, grid, cdf) - np.interp(z - q, grid, cdf)
    return float(min(1.0, max(0.0, 1 - k * np.trapezoid(phi * inside ** (k - 1), z))))


def binomial_upper(k: int, n: int) -> float:
    """P(at least k of n fair coins)."""
    return sum(comb(n, i) for i in range(k, n + 1)) / 2**n if n else 1.0


def holm(p: list[float]) -> list[float]:
    """Step-down adjusted p-values; one that is not a number counts 1."""
    p = [1.0 if v != v else v for v in p]
    out, running = [0.0] * len(p), 0.0
    for rank, k in enumerate(sorted(range(len(p)), key=p.__getitem__)):
        running = max(running, min(1.0, p[k] * (len(p) - rank)))
        out[k] = running
    return out


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """UPGMA merges (a, b, height, size) of a small symmetric matrix; missing distances count as the largest."""
    d = np.where(np.isnan(distance), np.nanmax(distance) if np.isfinite(distance).any() else 0.0, distance).astype(float)
    d = (d + d.T) / 2
    np.fill_diagonal(d, inf)
    names, size, out = list(range(len(d))), [1] * len(d), []
    for step in range(len(d) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(d)))
        out.append((min(names[i], names[j]), max(names[i], names[j]), float(d[i, j]), size[i] + size[j]))
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = inf
        d, size[i], names[i] = np.delete(np.delete(d, j, 0), j, 1), size[i] + size[j], len(distance) + step
        del size[j], names[j]
    return out
