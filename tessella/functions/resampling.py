"""Draws with replacement as column expressions, so that a bootstrap is made of joins and any engine draws alike.

Draw k of replicate r is a keyed permutation of whole numbers below the prime ``P``, two rounds of a fifth power (which maps
them one to one, as 5 does not divide P - 1), taken modulo the number of values. The steps are plain 64-bit arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config

P = 2**31 - 1
#: (column, expression): each step reads columns of the ones before it; no product exceeds 2^62.
STEPS = [
    ("x0", "(k * 1000003 + r * 7919 + {seed}) % {p}"), ("x1", "x0 * x0 % {p}"), ("x2", "x1 * x1 % {p}"), ("x3", "(x2 * x0 % {p} + r * 104729 + k) % {p}"),
    ("x4", "x3 * x3 % {p}"), ("x5", "x4 * x4 % {p}"), ("x6", "x5 * x3 % {p}"),
]


def steps(config: Config = CONFIG) -> list[tuple[str, str]]:
    return [(name, text.format(p=P, seed=config.seed)) for name, text in STEPS]


def hashed(rows: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Adds ``x``, a number below P, to rows with whole numbers r and k."""
    for name, text in steps(config):
        rows = rows.withColumn(name, F.expr(text))
    return rows.withColumn("x", F.col(STEPS[-1][0])).drop(*(name for name, _ in STEPS))


def upto(n: Column) -> Column:
    """0 .. n - 1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def draws(sizes: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(n, r, k, at) for the distinct ``n`` of ``sizes``: draw k of replicate r is value ``at`` of 0 .. n - 1.

    Groups of equal size share their draws, as generators with one seed do.
    """
    rows = sizes.select(F.col("n").cast("long").alias("n")).where("n > 0").distinct()
    rows = rows.select("n", upto(F.lit(config.draws)).alias("r")).repartition("n", "r")
    rows = hashed(rows.select("n", "r", upto(F.col("n")).alias("k")), config)
    return rows.select("n", "r", "k", (F.col("x") % F.col("n")).alias("at"))


def weights(sizes: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(n, r, at, w): how often each value is drawn in each replicate; values that are not drawn have no row."""
    return draws(sizes, config).groupBy("n", "r", "at").agg(F.count(F.lit(1)).alias("w"))


def middles(sizes: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(n, middles): for each replicate the two middle values drawn, which are one if n is odd."""
    drawn = draws(sizes, config).groupBy("n", "r").agg(F.sort_array(F.collect_list("at")).alias("s"))
    at = lambda k: F.get("s", F.expr(k).cast("int"))
    ends = drawn.select("n", F.struct("r", at("(n - 1) div 2").alias("low"), at("n div 2").alias("high")).alias("m"))
    return ends.groupBy("n").agg(F.sort_array(F.collect_list("m")).alias("middles"))


def quantile(ordered: Column, n: int, q: float) -> Column:
    """The q-quantile of an ordered array of n values, between neighbours by proportion."""
    whole = int(q * (n - 1))
    low, high = F.get(ordered, F.lit(whole)), F.get(ordered, F.lit(min(whole + 1, n - 1)))
    return low + (high - low) * (q * (n - 1) - whole)


def median_intervals(values: DataFrame, keys: list[str], column: str, low: float = 0.05, high: float = 0.95, config: Config = CONFIG) -> DataFrame:
    """Per group: n, the median and a percentile interval of resampled medians; NaN under three values.

    Nulls and NaN are left out. In an ordered group a resampled median is the mean of two of its values, at places that
    depend on its size alone. So a group is one ordered array, and no value is copied.
    """
    held = F.when(~F.isnan(column), F.col(column))
    groups = values.groupBy(*keys).agg(F.sort_array(F.collect_list(held)).alias("v")).withColumn("n", F.size("v").cast("long"))
    rows = groups.join(middles(groups.where("n >= 3").select("n"), config), "n", "left")
    between = lambda a, b: (F.get("v", a.cast("int")) + F.get("v", b.cast("int"))) / 2.0
    rows = rows.withColumn("made", F.sort_array(F.transform("middles", lambda m: between(m["low"], m["high"]))))
    enough = lambda c: F.when(F.col("n") >= 3, c).otherwise(F.lit(float("nan")))
    ends = [enough(quantile(F.col("made"), config.draws, q)).alias(name) for name, q in (("ci_low", low), ("ci_high", high))]
    return rows.select(*keys, "n", enough(between(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("median"), *ends)
