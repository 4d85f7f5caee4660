"""Compositional data as column expressions; lists hold one column a part, in canonical order."""

from __future__ import annotations

from functools import reduce
from math import sqrt
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def closure(parts: list[Column]) -> list[Column]:
    whole = total(parts)
    return [p / whole for p in parts]


def replace_zeros(counts: list[Column], strength: float = 0.5, fallback: bool = True) -> list[Column]:
    """Proportions with each zero part set to strength / n and the others shrunk to make room.

    No counts: equal parts. With ``fallback``, where the zeros would take everything, strength is added to each part
    instead and the result renormalised.
    """
    d, n = len(counts), total(counts).cast("double")
    zeros = total([(c == 0).cast("double") for c in counts])
    taken = zeros * strength / F.nullif(n, F.lit(0.0))
    out = []
    for c in counts:
        shrunk = F.when(c == 0, strength / n).otherwise(c / n * (1 - taken))
        value = F.when(n == 0, F.lit(1.0 / d)).when(zeros == 0, c / n)
        if fallback:
            value = value.when(taken >= 1, (c + strength) / (n + strength * d))
        out.append(value.otherwise(shrunk))
    return out


def to_common_total(counts: list[Column], whole: float) -> list[Column]:
    """Counts rescaled to one total; no counts stay none."""
    n = total(counts).cast("double")
    return [F.when(n > 0, c / n * whole).otherwise(F.lit(0.0)) for c in counts]


def alr(parts: list[Column], reference: int = 1) -> list[Column]:
    """Log of each part over the reference part, without the reference itself."""
    return [F.ln(p / parts[reference]) for k, p in enumerate(parts) if k != reference]


def ilr(parts: list[Column]) -> list[Column]:
    """Helmert coordinates: part k + 1 against the mean of the logs before it."""
    logs = [F.ln(p) for p in parts]
    return [F.lit(sqrt(k / (k + 1))) * (total(logs[:k]) / F.lit(float(k)) - logs[k]) for k in range(1, len(parts))]


def ilr_inverse(z: list[Column]) -> list[Column]:
    """The composition of Helmert coordinates."""
    d = len(z) + 1
    logs = []
    for part in range(d):
        terms = [z[k - 1] * (sqrt(k / (k + 1)) / k if part < k else -sqrt(k / (k + 1))) for k in range(max(part, 1), d)]
        logs.append(total(terms))
    return closure([F.exp(x) for x in logs])


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance of coordinates."""
    return F.sqrt(total([mul(x - y, x - y) for x, y in zip(a, b, strict=True)]))


def aitchison(p: list[Column], q: list[Column]) -> Column:
    return distance(ilr(closure(p)), ilr(closure(q)))
