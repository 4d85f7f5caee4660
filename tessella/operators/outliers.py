"""Methods that lie far from the consensus too often: tail flags, ranks, shares and permutation control."""

from __future__ import annotations

from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config
from tessella.functions import resampling
from tessella.functions.statistics import binomial_upper
from tessella.operators.counts import BLOCK
from tessella.operators.inference import average_rank
from tessella.sources.scratch import cut

SETTING = ["block_size", "overlap_pct"]
#: Sets of methods up to which one is drawn at once.
SETS = 20_000


def tail_cells(deviation: DataFrame, value: str = "mahalanobis_distance", config: Config = CONFIG) -> DataFrame:
    """Adds ``in_tail``: the distance exceeds the block's own quantile."""
    limit = deviation.groupBy(*BLOCK).agg(F.percentile(value, F.lit(config.tail)).alias("threshold"))
    return deviation.join(limit, BLOCK).withColumn("in_tail", F.col(value) > F.col("threshold"))


def tail_flags(cells: DataFrame) -> DataFrame:
    """Per setting and method: share of blocks in the tail, the share expected, and counts."""
    own = cells.groupBy(*SETTING, "nms_method").agg(F.sum(F.col("in_tail").cast("long")).alias("n_upper"), F.count(F.lit(1)).alias("n_blocks"))
    whole = Window.partitionBy(*SETTING)
    expected = F.sum("n_upper").over(whole) / F.sum("n_blocks").over(whole)
    return own.withColumn("frac_upper_tail", F.col("n_upper") / F.col("n_blocks")).withColumn("expected_frac", expected)


def dealt(histogram: DataFrame, config: Config = CONFIG) -> DataFrame:
    """(setting, r, j, n): how often method j of m gets a slot when every block deals its t slots to different methods.

    ``histogram`` has, per setting, the number of blocks nb with t of m slots, t under m. All sets of t methods are equally
    likely, so a block is one hash-indexed draw of a set, and draws are counted by set before methods are. Where there are more
    than ``SETS`` sets, a block's methods are ordered by a hash each and the first t taken.
    """
    kinds = [(r.m, r.t) for r in histogram.select("m", "t").distinct().collect()]  # at most one a number of slots
    few = [(m, t) for m, t in kinds if comb(m, t) <= SETS]
    spark = histogram.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(m, t, comb(m, t)) for m, t in few], "m long, t long, sets long"))
    rows = histogram.withColumn("r", resampling.upto(F.lit(config.draws))).repartition(*SETTING, "t", "r").withColumn("k", resampling.upto(F.col("nb")))
    drawn = resampling.hashed(rows.join(sizes, ["m", "t"]), config)
    drawn = drawn.groupBy(*SETTING, "r", "m", "t", (F.col("x") % F.col("sets")).alias("set")).count()
    members = spark.createDataFrame([(m, t, k, list(c)) for m, t in few for k, c in enumerate(combinations(range(m), t))], "m long, t long, set long, members array<long>")
    out = drawn.join(members, ["m", "t", "set"]).select(*SETTING, "r", F.explode("members").alias("j"), "count")
    if len(few) < len(kinds):
        each = rows.join(sizes, ["m", "t"], "left_anti").withColumn("j", resampling.upto(F.col("m")))
        each = resampling.hashed(each.withColumnRenamed("k", "b").withColumn("k", F.col("b") * F.col("m") + F.col("j")), config)
        order = F.row_number().over(Window.partitionBy(*SETTING, "t", "r", "b").orderBy("x", "j"))
        out = out.unionByName(each.withColumn("nth", order).where("nth <= t").select(*SETTING, "r", "j", F.lit(1).cast("long").alias("count")))
    return out.groupBy(*SETTING, "r", "j").agg(F.sum("count").alias("n"))


def permutation(cells: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Family-wise p-values by the largest count of any method when each block's tail slots are dealt at random.

    Only the histogram of slots by block matters, so replicates are drawn from it; all is joins and sums.
    """
    own = tail_flags(cells)
    slots = cells.groupBy(*BLOCK).agg(F.sum(F.col("in_tail").cast("long")).alias("t")).where("t > 0")
    counts = own.groupBy(*SETTING).agg(F.count(F.lit(1)).alias("m"))
    histogram = cut(slots.groupBy(*SETTING, "t").agg(F.count(F.lit(1)).alias("nb")).join(counts, SETTING), "outlier-slots")  # a row a number of slots
    most = dealt(histogram.where("t < m"), config).groupBy(*SETTING, "r").agg(F.max("n").alias("most"))
    full = histogram.groupBy(*SETTING).agg(F.sum(F.when(F.col("t") >= F.col("m"), F.col("nb")).otherwise(0)).alias("full"))  # all methods get one
    every = full.withColumn("r", resampling.upto(F.lit(config.draws))).join(most, [*SETTING, "r"], "left")
    null = every.groupBy(*SETTING, (F.col("full") + F.coalesce("most", F.lit(0))).alias("top")).count()
    beaten = own.join(null, SETTING, "left").groupBy(*SETTING, "nms_method", "n_upper", "n_blocks", "frac_upper_tail", "expected_frac")
    over = F.sum(F.when(F.col("top") >= F.col("n_upper"), F.col("count")).otherwise(0))
    p = F.when(F.sum("count").isNull(), 1.0).otherwise((1 + over) / F.lit(config.draws + 1.0))
    return beaten.agg(p.alias("p_value")).withColumn("flagged_outlier", F.col("p_value") < config.alpha)


def summary(flags: DataFrame) -> DataFrame:
    """Over settings: how often each method is flagged, and its mean tail share."""
    return flags.groupBy("nms_method").agg(
        F.sum(F.col("flagged_outlier").cast("long")).alias("n_settings_flagged"), F.count(F.lit(1)).alias("n_settings_total"),
        F.avg(F.col("flagged_outlier").cast("double")).alias("frac_settings_flagged"), F.avg("frac_upper_tail").alias("mean_frac_upper_tail"),
    )


def ranks(deviation: DataFrame, value: str = "mahalanobis_distance") -> DataFrame:
    """Average rank of each method inside its block, 1 the closest."""
    return deviation.withColumn("rank", average_rank(value, BLOCK))


def largest_share(deviation: DataFrame, value: str = "mahalanobis_distance") -> DataFrame:
    """Per setting and method: how often it deviates most, ties shared equally."""
    block = Window.partitionBy(*BLOCK)
    rows = deviation.withColumn("is_max", (F.col(value) == F.max(value).over(block)).cast("double"))
    rows = rows.withColumn("share", F.col("is_max") / F.sum("is_max").over(block))
    units = F.count_distinct(F.struct("slide_id", "block_x", "block_y"))
    whole = rows.groupBy(*SETTING).agg(units.alias("units"))
    return rows.groupBy(*SETTING, "nms_method").agg(F.sum("share").alias("share")).join(whole, SETTING).select(*SETTING, "nms_method", (F.col("share") / F.col("units")).alias("frac_largest"))


def sign_test(cells: DataFrame, method: str = "none") -> DataFrame:
    """Per setting: on how many slides the method is in the tail more often than chance, and the one-sided sign test."""
    chance = cells.groupBy(*SETTING).agg((F.sum(F.col("in_tail").cast("double")) / F.count_distinct(F.struct("slide_id", "block_x", "block_y")) / F.count_distinct("nms_method")).alias("chance"))
    own = cells.where(F.col("nms_method") == method).groupBy(*SETTING, "slide_id").agg(F.avg(F.col("in_tail").cast("double")).alias("rate"))
    rows = own.join(chance, SETTING).groupBy(*SETTING, "chance").agg(F.count(F.lit(1)).alias("n_slides"), F.sum((F.col("rate") > F.col("chance")).cast("long")).alias("n_slides_above"))

    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_upper(int(a), int(b)) for a, b in zip(k, n, strict=True)])

    return rows.withColumn("p_sign", p("n_slides_above", "n_slides"))
