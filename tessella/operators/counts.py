"""Survivor counts of slides, tiles and blocks, and eligibility.

Counts are kept one row a unit with a column for each label (``Mac Lym Neu Eos``), zero where a label is absent;
``long`` turns them into a row a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config
from tessella.operators.suppress import REGISTRY, Variant

SLIDE = ["slide_id", "overlap_pct"]
BLOCK = [*SLIDE, "block_size", "block_x", "block_y"]


def _by_method(masked: DataFrame, keys: list[str], names: list[str], config: Config) -> DataFrame:
    bits = [F.sum(F.shiftright("mask", k).bitwiseAND(1)).alias(f"m{k}") for k in range(len(names))]
    sums = masked.groupBy(*keys, "label").agg(*bits)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("nms_method"), F.col(f"m{k}").alias("n")) for k, n in enumerate(names)))).alias("x")
    rows = sums.select(*keys, "label", each).select(*keys, "label", "x.*")
    labels = [F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(s) for label, s in zip(config.labels, config.short, strict=True)]
    return rows.groupBy(*keys, "nms_method").agg(*labels)


def cells(masked: DataFrame, variants: dict[str, Variant] | None = None, config: Config = CONFIG) -> DataFrame:
    """Slide totals of each variant; slides without survivors count zero."""
    return _by_method(masked, SLIDE, list(variants or REGISTRY), config)


def tiles(masked: DataFrame, variants: dict[str, Variant] | None = None, config: Config = CONFIG) -> DataFrame:
    """Tile totals of each variant; a tile without survivors of a variant has no row for it."""
    rows = _by_method(masked, [*SLIDE, "tile_x", "tile_y"], list(variants or REGISTRY), config)
    return rows.where(total(config) > 0)


def total(config: Config = CONFIG):
    return sum((F.col(s) for s in config.short[1:]), F.col(config.short[0]))


def long(counts: DataFrame, config: Config = CONFIG, rel: bool = False) -> DataFrame:
    """A row a label: ``label``, ``count`` and, if asked for, ``rel_count`` (0 where the unit is empty)."""
    keys = [c for c in counts.columns if c not in config.short]
    parts = [F.struct(F.lit(label).alias("label"), F.col(s).alias("count")) for label, s in zip(config.labels, config.short, strict=True)]
    rows = counts.withColumn("_total", total(config)).select(*keys, "_total", F.explode(F.array(*parts)).alias("x")).select(*keys, "_total", "x.*")
    if rel:
        rows = rows.withColumn("rel_count", F.coalesce(F.try_divide(F.col("count").cast("double"), F.col("_total").cast("double")), F.lit(0.0)))
    return rows.drop("_total")


def blocks(tile_counts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Disjoint n x n tile blocks of all sizes in one pass; size 0 is the whole slide."""
    sizes = F.explode(F.array(*(F.lit(n).cast("long") for n in config.block_sizes))).alias("block_size")
    rows = tile_counts.select("*", sizes)
    place = {f"block_{a}": F.when(F.col("block_size") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"tile_{a} div greatest(block_size, 1)")) for a in "xy"}
    rows = rows.withColumns(place).groupBy(*BLOCK, "nms_method").agg(*(F.sum(s).alias(s) for s in config.short))
    return rows.withColumn("n_block_total", total(config))


def eligible(block_counts: DataFrame, min_cells: int | None = None, config: Config = CONFIG) -> DataFrame:
    """Keys of the blocks that have enough cells under the mask method, whatever other methods leave."""
    least = config.min_cells if min_cells is None else min_cells
    return block_counts.where((F.col("nms_method") == config.mask_method) & (F.col("n_block_total") >= least)).select(*BLOCK)


def masked_blocks(block_counts: DataFrame, min_cells: int | None = None, config: Config = CONFIG) -> DataFrame:
    return block_counts.join(eligible(block_counts, min_cells, config), BLOCK, "left_semi")


def min_cells_filter(block_counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows with enough cells of their own, and the share of rows retained by block size."""
    good = F.col("n_block_total") >= least
    share = block_counts.groupBy("block_size").agg(F.avg(good.cast("double")).alias("retained"))
    return block_counts.where(good), share


def zero_frequencies(eligible_counts: DataFrame, config: Config = CONFIG) -> DataFrame:
    rows = long(eligible_counts, config).groupBy("block_size", "overlap_pct", "nms_method", "label")
    rows = rows.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum((F.col("count") == 0).cast("long")).alias("n_zero"))
    return rows.withColumn("frac_zero", F.col("n_zero") / F.col("n_blocks"))


def cells_per_block(eligible_counts: DataFrame) -> DataFrame:
    n = F.col("n_block_total")
    return eligible_counts.groupBy("block_size", "overlap_pct", "nms_method").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.percentile(n, F.lit(0.5)).alias("median_cells"), F.percentile(n, F.lit(0.05)).alias("q05_cells"), F.min(n).alias("min_cells")
    )
