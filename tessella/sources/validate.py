"""Checks and derived columns of loaded detections, and the work list of a resumable run."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config


class LoadError(ValueError):
    """A file that can't be loaded."""


def require_columns(df: DataFrame, names) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise LoadError(f"missing columns: {', '.join(missing)}")


def known_labels(df: DataFrame, labels=CONFIG.labels) -> DataFrame:
    return df.where(F.col("label").isin(*labels))


def stride(config: Config = CONFIG) -> Column:
    """Pixels between tile origins at a row's overlap."""
    return F.greatest(F.round(config.tile * (1 - F.col("overlap_pct"))), F.lit(1.0)).cast("long")


def relative_only(df: DataFrame, config: Config = CONFIG) -> None:
    """Boxes must be relative to their tile: a coordinate over one and a half tiles says they are not."""
    largest = df.agg(F.max(F.greatest("x1", "y1", "x2", "y2"))).first()[0]
    if largest is not None and largest > 1.5 * config.tile:
        raise LoadError(f"coordinates up to {largest} are already absolute")


def absolute(df: DataFrame) -> DataFrame:
    """Tile-relative boxes at their place in the image, with centres."""
    rows = df.withColumns({c: F.col(c) + F.col(f"{c[0]}_correct") for c in ("x1", "y1", "x2", "y2")})
    return rows.withColumns({"cx": (F.col("x1") + F.col("x2")) / F.lit(2.0), "cy": (F.col("y1") + F.col("y2")) / F.lit(2.0)})


def tile_index(df: DataFrame, config: Config = CONFIG) -> DataFrame:
    s = stride(config)
    return df.withColumns({f"tile_{a}": F.floor(F.col(f"{a}_correct") / s).cast("long") for a in "xy"})


def grid_shares(df: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Per slide and overlap: the share of tile origins that lie on the grid."""
    on = {a: F.avg((F.col(f"{a}_correct") % stride(config) == 0).cast("double")).alias(f"share_{a}") for a in "xy"}
    return df.groupBy("slide_id", "overlap_pct").agg(*on.values())


def check_grid(df: DataFrame, config: Config = CONFIG) -> None:
    bad = grid_shares(df, config).where(f"least(share_x, share_y) < {config.grid_tolerance}").first()
    if bad is not None:
        raise LoadError(f"tile origins of {bad.slide_id} are off the grid of overlap {bad.overlap_pct}")


def bounds(df: DataFrame, slides: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Per slide and overlap: the largest coordinates, and whether they are inside the image plus one tile."""
    far = df.groupBy("slide_id", "overlap_pct").agg(F.max("x2").alias("max_x"), F.max("y2").alias("max_y"))
    inside = (F.col("max_x") <= F.col("image_w") + config.tile) & (F.col("max_y") <= F.col("image_h") + config.tile)
    return far.join(slides, "slide_id").select("slide_id", "overlap_pct", "max_x", "max_y", inside.alias("inside"))


def check_bounds(df: DataFrame, slides: DataFrame, config: Config = CONFIG) -> None:
    bad = bounds(df, slides, config).where("not inside").first()
    if bad is not None:
        raise LoadError(f"boxes of {bad.slide_id} reach ({bad.max_x}, {bad.max_y}), outside its image")


def pending(units: DataFrame, methods: list[str], done: DataFrame) -> DataFrame:
    """Every unit and method that ``done`` lacks."""
    names = F.explode(F.array(*map(F.lit, methods))).alias("nms_method")
    return units.select("slide_id", "overlap_pct", names).join(done, ["slide_id", "overlap_pct", "nms_method"], "left_anti")


def median_of_medians(rows: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """The median over units of each unit's median: ``outer`` keys, ``median`` and the number of units."""
    each = rows.groupBy(*outer, *inner).agg(F.median(value).alias("m"))
    return each.groupBy(*outer).agg(F.median("m").alias("median"), F.count(F.lit(1)).alias("n_units"))


def timing_summary(times: DataFrame) -> DataFrame:
    """CPU time of each variant: the median of a slide's repeats, then of slides."""
    rows = median_of_medians(times, "elapsed_cpu", ["slide_id"], ["overlap_pct", "nms_method"])
    return rows.withColumnsRenamed({"median": "median_cpu", "n_units": "n_slides"})


def compare(left: DataFrame, right: DataFrame, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Two result tables side by side: ``status`` of each key and the gap of each column.

    ``agrees`` if every column is within its tolerance (two nulls or two NaN agree, one alone does not), ``differs`` if not,
    ``only left`` or ``only right`` where the other lacks the key. Keys are unique in each table; null keys match.
    """
    a, b = (t.select(F.struct(*keys).alias("key"), F.struct(*(F.col(c).cast("double").alias(c) for c in tolerance)).alias(side)) for t, side in ((left, "l"), (right, "r")))
    rows = a.join(b.withColumnRenamed("key", "other"), F.col("key").eqNullSafe(F.col("other")), "full")
    pairs = {c: (F.col(f"l.{c}"), F.col(f"r.{c}")) for c in tolerance}
    close = [F.coalesce(x.eqNullSafe(y) | (F.abs(x - y) <= tolerance[c]), F.lit(False)) for c, (x, y) in pairs.items()]
    status = F.when(F.col("other").isNull(), "only left").when(F.col("key").isNull(), "only right").when(reduce(and_, close), "agrees").otherwise("differs")
    return rows.select(F.coalesce("key", "other").alias("key"), status.alias("status"), *(F.abs(x - y).alias(f"gap_{c}") for c, (x, y) in pairs.items())).select("key.*", "status", *(f"gap_{c}" for c in tolerance))
