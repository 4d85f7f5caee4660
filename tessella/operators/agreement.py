"""Krippendorff's alpha of compositions, its zero-handling regimes, and slide-cluster bootstrap intervals.

Alpha needs, per slide, only sums over complete blocks: their number, the within-block disagreement, the sum of squares
and the coordinate sums. A bootstrap replicate weighs these rows by how often a slide was drawn, so no panel is copied.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config
from tessella.functions import compositional as comp
from tessella.functions import resampling
from tessella.operators.counts import BLOCK

SETTING = ["block_size", "overlap_pct"]


def coordinates(eligible_counts: DataFrame, regime: str = "as_is", config: Config = CONFIG, multiplier: float = 1.0) -> DataFrame:
    """Block keys, method and ilr coordinates z1.. of masked block counts.

    Regimes: ``as_is``; ``common_scale`` rescales counts to one total before zeros are replaced; ``no_eos`` leaves the
    last label out. ``multiplier`` scales counts (4 reproduces a join that repeated each row by label).
    """
    z = _ilr(regime, config, multiplier)
    return eligible_counts.select(*BLOCK, "nms_method", *(x.alias(f"z{k}") for k, x in enumerate(z, 1)))


def _ilr(regime: str, config: Config, multiplier: float = 1.0) -> list:
    parts = [F.col(s).cast("double") * multiplier for s in config.short]
    if regime == "no_eos":
        parts = parts[:-1]
    if regime == "common_scale":
        parts = comp.to_common_total(parts, config.common_total)
    return comp.ilr(comp.replace_zeros(parts))


def _units(panel: DataFrame, n_methods: int, groups: list[list[str]]) -> DataFrame:
    """Complete blocks with, for each coordinate, the within-block disagreement d_, the sum of squares q_ and the sum s_."""
    z = [c for g in groups for c in g]
    units = panel.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("m"), *(F.sum(c).alias(f"s_{c}") for c in z), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in z))
    pairs = n_methods * (n_methods - 1) / 2.0
    units = units.where(F.col("m") == n_methods).drop("m")
    return units.withColumns({f"d_{c}": (n_methods * F.col(f"q_{c}") - F.col(f"s_{c}") * F.col(f"s_{c}")) / pairs for c in z})


def slide_sums(panel: DataFrame, n_methods: int) -> DataFrame:
    """Per setting and slide: complete blocks, within-block disagreement, sum of squares, coordinate sums; and by coordinate."""
    z = [c for c in panel.columns if c[0] == "z" and c[1:].isdigit()]
    units = _units(panel, n_methods, [z])
    whole = [reduce(add, (F.sum(f"{p}_{c}") for c in z)).alias(p) for p in "dq"]
    return units.groupBy(*SETTING, "slide_id").agg(F.count(F.lit(1)).alias("blocks"), *whole, *(F.sum(f"{p}_{c}").alias(f"{p}_{c}") for p in "dqs" for c in z))


def _alpha(m: int, blocks, d, q, s2):
    n = blocks * m
    expected = (2 * n * q - 2 * s2) / (n * (n - 1))
    observed = d / blocks
    value = F.when(expected > 0, 1 - observed / expected).when(observed <= 0, F.lit(1.0)).otherwise(F.lit(float("nan")))
    return F.when(blocks < 2, F.lit(float("nan"))).otherwise(value) if m > 1 else F.lit(float("nan"))


def alpha(sums: DataFrame, n_methods: int) -> DataFrame:
    """Alpha over all coordinates and for each, per setting."""
    z = [c[2:] for c in sums.columns if c.startswith("d_")]
    names = ["blocks", "d", "q", *(f"{p}_{c}" for p in "dqs" for c in z)]
    whole = sums.groupBy(*SETTING).agg(*(F.sum(x).alias(x) for x in names))
    s2 = sum((F.col(f"s_{c}") ** 2 for c in z[1:]), F.col(f"s_{z[0]}") ** 2)
    each = {f"alpha_coord_{k}": _alpha(n_methods, F.col("blocks"), F.col(f"d_{c}"), F.col(f"q_{c}"), F.col(f"s_{c}") ** 2) for k, c in enumerate(z, 1)}
    return whole.select(*SETTING, F.col("blocks").alias("n_blocks"), _alpha(n_methods, F.col("blocks"), F.col("d"), F.col("q"), s2).alias("alpha"), *(v.alias(k) for k, v in each.items()))


def bootstrap(sums: DataFrame, n_methods: int, config: Config = CONFIG) -> DataFrame:
    """Alpha with a 95 % interval over slides drawn with replacement, per setting.

    A replicate's sums are those of the slides' rows, weighed by how often each slide is drawn.
    """
    z = [c for c in sums.columns if c.startswith("s_")]
    parts = ["blocks", "d", "q", *z]
    place = Window.partitionBy(*SETTING)  # a row a slide
    rows = sums.select(*SETTING, *parts, (F.row_number().over(place.orderBy("slide_id")) - 1).cast("long").alias("at"), F.count(F.lit(1)).over(place).alias("n"))
    drawn = rows.join(resampling.weights(rows.select("n"), config), ["n", "at"]).groupBy(*SETTING, "r").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in parts))
    value = lambda: _alpha(n_methods, F.col("blocks"), F.col("d"), F.col("q"), reduce(add, (F.col(c) * F.col(c) for c in z)))
    made = drawn.select(*SETTING, F.nanvl(value(), F.lit(None)).alias("value"))
    ends = made.groupBy(*SETTING).agg(*(F.coalesce(F.percentile("value", F.lit(q)), F.lit(float("nan"))).alias(c) for c, q in (("lo95", 0.025), ("hi95", 0.975))))
    whole = sums.groupBy(*SETTING).agg(*(F.sum(c).alias(c) for c in parts)).select(*SETTING, value().alias("alpha"), F.col("blocks").cast("long").alias("n_blocks_used"))
    return whole.join(ends, SETTING).select(*SETTING, "alpha", "lo95", "hi95", "n_blocks_used")


def _alpha_array(m: int, sums: np.ndarray) -> np.ndarray:
    blocks, d, q, s = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3:]
    n = blocks * m
    with np.errstate(divide="ignore", invalid="ignore"):
        expected = (2 * n * q - 2 * (s * s).sum(1)) / (n * (n - 1))
        out = np.where(expected > 0, 1 - d / blocks / expected, np.where(d <= 0, 1.0, np.nan))
    return np.where((blocks < 2) | (m < 2), np.nan, out)


def scale_curve(block_counts: DataFrame, eligible_counts: DataFrame, n_methods: int, config: Config = CONFIG) -> DataFrame:
    """Alpha by block size and overlap, with its interval and the numbers of blocks used and left out by the mask."""
    per = bootstrap(slide_sums(coordinates(eligible_counts, config=config), n_methods), n_methods, config)
    place = F.struct("slide_id", "block_x", "block_y")
    every = block_counts.groupBy(*SETTING).agg(F.count_distinct(place).alias("n_all"))
    kept = eligible_counts.groupBy(*SETTING).agg(F.count_distinct(place).alias("n_kept"))
    rows = every.join(kept, SETTING, "left").join(per, SETTING, "left")
    filtered = (F.col("n_all") - F.coalesce("n_kept", F.lit(0))).alias("n_blocks_filtered")
    return rows.select(*SETTING, "alpha", "lo95", "hi95", F.coalesce("n_blocks_used", F.lit(0).cast("long")).alias("n_blocks_used"), filtered)


def zero_sensitivity(eligible_counts: DataFrame, n_methods: int, config: Config = CONFIG) -> DataFrame:
    """Alpha under each zero-handling regime, the gap of the scale-free one, and alpha by coordinate; in one pass over blocks."""
    panel, own = eligible_counts, {}
    for regime in ("as_is", "common_scale", "no_eos"):
        own[regime] = {f"{regime}_{k}": z for k, z in enumerate(_ilr(regime, config), 1)}
        panel = panel.withColumns(own[regime])
    units = _units(panel.select(*BLOCK, *(c for z in own.values() for c in z)), n_methods, [list(z) for z in own.values()])
    names = [c for c in units.columns if c not in BLOCK]
    sums = units.groupBy(*SETTING).agg(F.count(F.lit(1)).alias("blocks"), *(F.sum(c).alias(c) for c in names))

    def of(z):
        d, q, s2 = (reduce(add, (f(c) for c in z)) for f in (lambda c: F.col(f"d_{c}"), lambda c: F.col(f"q_{c}"), lambda c: F.col(f"s_{c}") ** 2))
        return _alpha(n_methods, F.col("blocks"), d, q, s2)

    each = [of([c]).alias(f"alpha_coord_{k}") for k, c in enumerate(own["as_is"], 1)]
    rows = sums.select(*SETTING, F.col("blocks").alias("n_blocks"), of(own["as_is"]).alias("alpha_as_is"), *each, of(own["common_scale"]).alias("alpha_common_scale"), of(own["no_eos"]).alias("alpha_no_eos"))
    return rows.withColumn("gap", F.col("alpha_common_scale") - F.col("alpha_as_is"))


def block_bootstrap(panel: DataFrame, n_methods: int, config: Config = CONFIG, pieces: int = 64) -> DataFrame:
    """Alpha with a 95 % interval over blocks drawn with replacement, all blocks alike, per setting.

    The draws are first dealt to pieces of the blocks, by one seeded multinomial draw that every piece repeats, and then
    inside each piece; so each replicate is an exact draw with replacement, and a piece sends only sums.
    """
    z = [c for c in panel.columns if c[0] == "z" and c[1:].isdigit()]
    columns = [f"{p}_{c}" for p in "dqs" for c in z]
    units = _units(panel, n_methods, [z]).withColumn("_piece", F.pmod(F.xxhash64("slide_id", "block_x", "block_y"), F.lit(pieces)))
    sizes = units.groupBy(*SETTING, "_piece").count().groupBy(*SETTING).agg(F.map_from_entries(F.collect_list(F.struct("_piece", "count"))).alias("_sizes"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK)
        own, held = int(pdf["_piece"].iloc[0]), dict(pdf["_sizes"].iloc[0])
        each = np.array([held.get(k, 0) for k in range(pieces)], np.int64)
        mine = np.random.default_rng(config.seed).multinomial(each.sum(), each / each.sum(), size=config.draws)[:, own]
        rows = np.c_[np.ones(len(pdf)), pdf[columns].to_numpy(float)]
        rng, even = np.random.default_rng([config.seed, own]), np.full(len(pdf), 1 / len(pdf))
        sums = np.vstack([rows.sum(0), *(rng.multinomial(mine[k : k + 100], even) @ rows for k in range(0, config.draws, 100))])
        out = pd.DataFrame(sums, columns=["blocks", *columns])
        return out.assign(block_size=pdf["block_size"].iloc[0], overlap_pct=pdf["overlap_pct"].iloc[0], draw=np.arange(len(out)))

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("draw")
        d, q, s = (rows[[f"{p}_{c}" for c in z]].to_numpy(float) for p in "dqs")
        value = _alpha_array(n_methods, np.c_[rows["blocks"], d.sum(1), q.sum(1), s])
        low, high = np.nanpercentile(value[1:], [2.5, 97.5]) if np.isfinite(value[1:]).any() else (np.nan, np.nan)
        return pd.DataFrame({"block_size": [pdf.block_size.iloc[0]], "overlap_pct": [pdf.overlap_pct.iloc[0]], "alpha": [value[0]], "lo95": [low], "hi95": [high]})

    schema = f"blocks double, {', '.join(f'{c} double' for c in columns)}, block_size long, overlap_pct double, draw long"
    parts = units.join(sizes, SETTING).groupBy(*SETTING, "_piece").applyInPandas(draw, schema)
    sums = parts.groupBy(*SETTING, "draw").agg(F.sum("blocks").alias("blocks"), *(F.sum(c).alias(c) for c in columns))
    return sums.groupBy(*SETTING).applyInPandas(interval, "block_size long, overlap_pct double, alpha double, lo95 double, hi95 double")
