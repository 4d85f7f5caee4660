"""Summaries across slides: weighted means, method distances, retention, percentages and classification changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config
from tessella.functions import compositional as comp
from tessella.functions.statistics import average_linkage
from tessella.operators.counts import total
from tessella.operators.inference import log_ratios

Z = ["ilr_1", "ilr_2", "ilr_3"]


def weighted_means(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Per overlap and method: ilr mean weighted by survivors, as coordinates, log-ratios and percentages."""
    rows = log_ratios(cells, config).join(cells.select("slide_id", "overlap_pct", "nms_method", total(config).alias("w")), ["slide_id", "overlap_pct", "nms_method"])
    mean = [F.when(F.sum("w") > 0, F.sum(F.col(z) * F.col("w")) / F.sum("w")).otherwise(F.avg(z)).alias(z) for z in Z]
    rows = rows.groupBy("overlap_pct", "nms_method").agg(F.count(F.lit(1)).alias("n_slides"), *mean)
    parts = comp.ilr_inverse([F.col(z) for z in Z])
    names = [s for k, s in enumerate(config.short) if k != config.reference]
    ratios = [r.alias(f"alr_{n}") for r, n in zip(comp.alr(parts, config.reference), names, strict=True)]
    return rows.select("overlap_pct", "nms_method", "n_slides", *Z, *ratios, *((p * 100).alias(f"pct_{s}") for p, s in zip(parts, config.short, strict=True)))


def distance_matrix(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Mean over slides of the ilr distance of each pair of methods, per overlap."""
    rows = log_ratios(cells, config).select("slide_id", "overlap_pct", "nms_method", *Z)
    a = rows.withColumnsRenamed({"nms_method": "method_a", **{z: f"a_{z}" for z in Z}})
    b = rows.withColumnsRenamed({"nms_method": "method_b", **{z: f"b_{z}" for z in Z}})
    gap = comp.distance([F.col(f"a_{z}") for z in Z], [F.col(f"b_{z}") for z in Z])
    return a.join(b, ["slide_id", "overlap_pct"]).groupBy("overlap_pct", "method_a", "method_b").agg(F.avg(gap).alias("distance"))


def dendrogram(matrix: DataFrame, overlap: float) -> list[tuple]:
    """Average-linkage merges of the methods; the matrix has a row and column a method."""
    rows = matrix.where(F.col("overlap_pct") == overlap).collect()
    names = sorted({r.method_a for r in rows} | {r.method_b for r in rows})
    at = {m: k for k, m in enumerate(names)}
    d = np.full((len(names), len(names)), np.nan)
    for r in rows:
        d[at[r.method_a], at[r.method_b]] = r.distance
    return [(*m, names) for m in average_linkage(d)]


def retention(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Pooled share of each class that a method retains of what stands without suppression."""
    pooled = cells.groupBy("overlap_pct", "nms_method").agg(*(F.sum(s).alias(s) for s in config.short))
    base = pooled.where("nms_method = 'none'").select("overlap_pct", *(F.col(s).alias(f"n_{s}") for s in config.short))
    share = [F.try_divide(F.col(s).cast("double"), F.col(f"n_{s}").cast("double")).alias(f"ret_{s}") for s in config.short]
    whole = F.try_divide(total(config).cast("double"), sum((F.col(f"n_{s}") for s in config.short[1:]), F.col(f"n_{config.short[0]}")).cast("double"))
    return pooled.join(base, "overlap_pct").select("overlap_pct", "nms_method", *share, whole.alias("ret_total"))


def retention_per_slide(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Medians over slides of class retention, of the log ratio of eosinophil to lymphocyte retention, and pooled retention."""
    base = cells.where("nms_method = 'none'").select("slide_id", "overlap_pct", *(F.col(s).alias(f"n_{s}") for s in config.short))
    rows = cells.where("nms_method <> 'none'").join(base, ["slide_id", "overlap_pct"])
    for s in config.short:
        rows = rows.withColumn(f"ret_{s}", F.try_divide(F.col(s).cast("double"), F.col(f"n_{s}").cast("double")))
    ratio = F.when((F.col("ret_Eos") > 0) & (F.col("ret_Lym") > 0), F.ln("ret_Eos") - F.ln("ret_Lym"))
    rows = rows.withColumn("ratio", ratio)
    return rows.groupBy("overlap_pct", "nms_method").agg(
        F.count(F.lit(1)).alias("n_slides"), *(F.median(f"ret_{s}").alias(f"median_ret_{s}") for s in config.short),
        F.median("ratio").alias("median_log_ret_ratio_Eos_Lym"), F.sum((F.col("ratio") > 0).cast("long")).alias("n_slides_Eos_retained_more"),
        (F.sum(total(config)) / F.sum(sum((F.col(f"n_{s}") for s in config.short[1:]), F.col(f"n_{config.short[0]}")))).alias("pooled_ret_total"),
    )


# Shares in percent above which a slide counts as positive.
LIMITS = {"Lym": 15.0, "Neu": 3.0, "Eos": 1.0}


def percentages(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    n = total(config).cast("double")
    return cells.select("slide_id", "overlap_pct", "nms_method", *(F.coalesce(F.try_divide(F.col(s) * 100.0, n), F.lit(0.0)).alias(f"pct_{s}") for s in config.short))


def classification_changes(cells: DataFrame, reference: str = "none", config: Config = CONFIG) -> DataFrame:
    """Per overlap, method and class: slides above the class's limit, and those whose verdict differs from the reference's."""
    parts = F.array(*(F.struct(F.lit(s).alias("class"), (F.col(f"pct_{s}") > v).alias("positive")) for s, v in LIMITS.items()))
    rows = percentages(cells, config).select("slide_id", "overlap_pct", "nms_method", F.explode(parts).alias("x")).select("slide_id", "overlap_pct", "nms_method", "x.*")
    keys = ["slide_id", "overlap_pct", "class"]
    base = rows.where(F.col("nms_method") == reference).select(*keys, F.col("positive").alias("was"))
    rows = rows.where(F.col("nms_method") != reference).join(base, keys)
    changed = F.when(F.col("positive") != F.col("was"), F.col("slide_id"))
    return rows.groupBy("overlap_pct", "nms_method", "class").agg(
        F.sum(F.col("positive").cast("long")).alias("n_positive"), F.count(changed).alias("n_changed"), F.array_join(F.sort_array(F.collect_list(changed)), ";").alias("slides_changed")
    )


#: Quartile distances that a whisker spans; the excess keeps a value inside that lies on the limit but for rounding.
WHISKER = 1.5 + 1e-9


def boxes(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """What a box plot of ``value`` shows: quartiles, whiskers to the last values within 1.5 quartile distances, ends, and
    how many values lie beyond the whiskers. Quartiles and whiskers are two aggregations, so a group of any size is never held."""
    cuts = rows.groupBy(*keys).agg(*(F.percentile(value, F.lit(q)).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))))
    reach = (F.col("q75") - F.col("q25")) * WHISKER
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    within = F.when(inside, F.col(value))
    made = rows.select(*keys, value).where(F.col(value).isNotNull()).join(cuts, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.min(within).alias("whisker_low"), *(F.first(c).alias(c) for c in ("q25", "median", "q75")),
        F.max(within).alias("whisker_high"), F.max(value).alias("high"), F.sum((~inside).cast("long")).alias("n_outside"),
    )
    return made


def pseudonymised(rows: DataFrame, slides: DataFrame) -> DataFrame:
    """``rows`` with pseudonyms in place of slide ids."""
    return rows.join(pseudonyms(slides), "slide_id").select("pseudonym", *(c for c in rows.columns if c != "slide_id"))


def pseudonyms(slides: DataFrame) -> DataFrame:
    """slide_id with S01, S02 ... in order; one row a slide."""
    names = slides.select("slide_id").distinct()
    return names.withColumn("pseudonym", F.format_string("S%02d", F.row_number().over(Window.orderBy("slide_id"))))
