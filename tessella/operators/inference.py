"""Slide-level inference on log-ratios: equivalence, Friedman, Holm and Nemenyi, and the tables made from them."""

from __future__ import annotations

from math import log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config
from tessella.functions import compositional as comp
from tessella.functions import resampling
from tessella.functions import statistics as stats

COORDS = ["alr_Mac", "alr_Neu", "alr_Eos"]


def log_ratios(cells: DataFrame, config: Config = CONFIG, strength: float = 0.5, common: float | None = None, fallback: bool = True) -> DataFrame:
    """slide, overlap, method with alr_* and ilr_* of the slide's composition; slides without survivors are left out."""
    parts = [F.col(s).cast("double") for s in config.short]
    rows = cells.where(comp.total(parts) > 0)
    if common:
        parts = comp.to_common_total(parts, common)
    p = comp.replace_zeros(parts, strength, fallback)
    names = [s for k, s in enumerate(config.short) if k != config.reference]
    ratios = [x.alias(f"alr_{n}") for x, n in zip(comp.alr(p, config.reference), names, strict=True)]
    return rows.select("slide_id", "overlap_pct", "nms_method", *ratios, *(x.alias(f"ilr_{k}") for k, x in enumerate(comp.ilr(p), 1)))


def left_out(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    """By overlap and method, how many slides have no survivors and so no log-ratios; only where there are any."""
    total = comp.total([F.col(s).cast("double") for s in config.short])
    none = F.count(F.when(total > 0, None).otherwise(F.lit(1)))
    return cells.groupBy("overlap_pct", "nms_method").agg(none.alias("n_left_out"), F.count(F.lit(1)).alias("n_slides")).where("n_left_out > 0")


def long_ratios(ratios: DataFrame, columns: list[str] = COORDS) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(c).alias("coord"), F.col(c).alias("value")) for c in columns))
    keys = [c for c in ratios.columns if not c.startswith(("alr_", "ilr_"))]
    return ratios.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*")


def differences(long: DataFrame, reference: str = "none") -> DataFrame:
    """Each method minus the reference, paired by slide: slide, overlap, method, coord, diff."""
    keys = [c for c in long.columns if c not in ("nms_method", "value")]
    base = long.where(F.col("nms_method") == reference).select(*keys, F.col("value").alias("base"))
    rows = long.where(F.col("nms_method") != reference).join(base, keys)
    return rows.withColumn("diff", F.col("value") - F.col("base")).drop("value", "base")


def paired(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """Differences method - other for (scope, method, other) pairs."""
    keys = [c for c in long.columns if c not in ("nms_method", "value")]
    a = long.join(pairs, long["nms_method"] == pairs["method"]).drop("nms_method")
    b = long.withColumnsRenamed({"nms_method": "other", "value": "base"})
    rows = a.join(b, [*keys, "other"])
    return rows.select(*keys, "scope", (F.col("value") - F.col("base")).alias("diff"))


def equivalence(diffs: DataFrame, keys: list[str], config: Config = CONFIG, margin: float | None = None) -> DataFrame:
    """n, median, 90 % interval and whether it lies inside the margin, per group of paired differences (one a slide)."""
    m = config.margin if margin is None else margin
    rows = resampling.median_intervals(diffs, keys, "diff", config=config)
    inside = ~F.isnan("ci_low") & (F.col("ci_low") > -m) & (F.col("ci_high") < m)
    return rows.withColumn("equivalent", inside)


def margins(tested: DataFrame, limits=(0.10, 0.15, 0.20)) -> DataFrame:
    """The verdict under each margin, from the intervals."""
    rows = tested.select("*", F.explode(F.array(*map(F.lit, limits))).alias("margin"))
    return rows.withColumn("equivalent", ~F.isnan("ci_low") & (F.col("ci_low") > -F.col("margin")) & (F.col("ci_high") < F.col("margin")))


def distribution(diffs: DataFrame, keys: list[str], margin: float = CONFIG.margin) -> DataFrame:
    d = F.col("diff")
    quantiles = {"median": 0.5, "q05": 0.05, "q95": 0.95}
    return diffs.where(d.isNotNull()).groupBy(*keys).agg(
        F.count(d).alias("n"), *(F.percentile(d, F.lit(q)).alias(k) for k, q in quantiles.items()), F.min(d).alias("min"), F.max(d).alias("max"),
        F.sum((F.abs(d) > margin).cast("long")).alias("n_outside"), F.sum((F.abs(d) > margin / 2).cast("long")).alias("n_outside_half"),
    )


def average_rank(value: str, within: list[str]):
    """Rank in a group with ties averaged."""
    rank = F.rank().over(Window.partitionBy(*within).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*within, value))
    return rank + (ties - 1) / 2.0


def friedman(long: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Chi-squared with the tie correction, Kendall's W, p and Holm-adjusted p, per overlap and coordinate.

    Subjects are the slides that have every method; at least three methods and three slides, else no row.
    """
    keys = ["overlap_pct", "coord"]
    long = long.where(F.col("value").isNotNull())
    methods = long.groupBy(*keys).agg(F.count_distinct("nms_method").alias("k"))
    whole = long.groupBy(*keys, "slide_id").agg(F.count(F.lit(1)).alias("own")).join(methods, keys).where("own = k and k >= 3")
    rows = long.join(whole.select(*keys, "slide_id", "k"), [*keys, "slide_id"])
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, "slide_id", "value"))
    rows = rows.withColumn("rank", average_rank("value", [*keys, "slide_id"])).withColumn("t2", (ties * ties - 1).cast("double"))
    sums = rows.groupBy(*keys, "nms_method").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.first("k").alias("k"), F.sum("t2").alias("t"))
    # a tie of t values adds t^3 - t, that is t^2 - 1 for each of them
    one = sums.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("r2"), F.first("n").alias("n"), F.first("k").alias("k"), F.sum("t").alias("t")).where("n >= 3")
    n, k = F.col("n"), F.col("k")
    even = 12.0 / (n * k * (k + 1)) * F.col("r2") - 3.0 * n * (k + 1)
    fair = 1.0 - F.col("t") / (n * k * (k * k - 1.0))
    one = one.withColumn("statistic", F.when(fair > 0, even / fair).otherwise(F.lit(float("nan"))))
    one = one.withColumn("kendall_w", F.col("statistic") / (n * (k - 1)))
    rows = one.select(*keys, "statistic", (k - 1).alias("df"), "kendall_w", F.col("n").alias("n_subjects"), F.col("k").alias("n_methods"))

    @F.pandas_udf("double")
    def log10_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([0.0 if s != s else stats.chi2_log_sf(s, d) / log(10) for s, d in zip(statistic, df, strict=True)])

    rows = rows.withColumn("log10_p", log10_p("statistic", "df")).withColumn("p_value", F.pow(F.lit(10.0), "log10_p"))
    return holm(rows, ["overlap_pct"])


def holm(rows: DataFrame, family: list[str], p: str = "p_value") -> DataFrame:
    """Adds ``p_holm``; a missing p counts 1."""
    rows = rows.withColumn("_p", F.when(F.col(p).isNull() | F.isnan(p), 1.0).otherwise(F.col(p)))
    order = Window.partitionBy(*family).orderBy("_p", *[c for c in ("coord", "nms_method") if c in rows.columns])
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), F.col("_p") * (size - F.row_number().over(order) + 1))
    rows = rows.withColumn("_step", step)
    return rows.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_step")


def mean_ranks(long: DataFrame) -> DataFrame:
    keys = ["overlap_pct", "coord"]
    ranked = long.withColumn("rank", average_rank("value", [*keys, "slide_id"]))
    return ranked.groupBy(*keys, "nms_method").agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def nemenyi(long: DataFrame) -> DataFrame:
    """All pairs of methods: the studentised rank difference and its p-value."""
    keys = ["overlap_pct", "coord"]
    ranks = mean_ranks(long)
    k = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    a = ranks.withColumnsRenamed({"nms_method": "method_a", "mean_rank": "rank_a"})
    b = ranks.select(*keys, F.col("nms_method").alias("method_b"), F.col("mean_rank").alias("rank_b"))
    rows = a.join(b, keys).where("method_a < method_b").join(k, keys)
    q = F.abs(F.col("rank_a") - F.col("rank_b")) / F.sqrt(F.col("k") * (F.col("k") + 1) / (12.0 * F.col("n")))

    @F.pandas_udf("double")
    def p(q: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([stats.studentised_range_sf(x, int(n)) for x, n in zip(q, k, strict=True)])

    rows = rows.withColumn("q", q)
    return rows.select(*keys, "method_a", "method_b", "q", p("q", "k").alias("p_value"))


def verdicts(tested: DataFrame, reference: str = "iou_grid_n1") -> DataFrame:
    """Per overlap: whether all methods are equivalent on all coordinates, and whether the reference is."""
    mine = F.col("nms_method") == reference
    return tested.groupBy("overlap_pct").agg(
        F.bool_and("equivalent").alias("all_equivalent"), F.coalesce(F.bool_and(F.when(mine, F.col("equivalent"))), F.lit(False)).alias("reference_equivalent")
    )
