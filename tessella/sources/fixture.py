"""Detections derived from ``lineitem`` by integer arithmetic, as a stand-in for a detector's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns whose order numbers the detections; unique in all tables.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
RANGE = 4096


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections table of a folder of tables."""
    return derived(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def derived(lineitem: DataFrame) -> DataFrame:
    """Detections of the table's rows. Row numbers are dealt by ranges of the order key, so no task sorts the whole table."""
    rows = lineitem.select(*ORDER)
    rows = rows.withColumn("part", F.expr(f"l_orderkey div {RANGE}"))
    sizes = rows.groupBy("part").count()
    start = (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("start")
    starts = sizes.select("part", start)  # a row for each range
    number = F.row_number().over(Window.partitionBy("part").orderBy(*ORDER))
    rows = rows.join(starts, "part").withColumn("det_id", (number + F.coalesce("start", F.lit(0))).cast("long"))
    label = F.expr(
        """CASE WHEN l_orderkey % 100 < 60 THEN 'Makrophage' WHEN l_orderkey % 100 < 90 THEN 'Lymphozyt'
        WHEN l_orderkey % 100 < 97 THEN 'NeutrophilerGranulozyt' ELSE 'EosinophilerGranulozyt' END"""
    )
    rows = rows.select(
        "det_id",
        F.expr("concat('S', CAST(l_suppkey % 8 AS STRING))").alias("slide_id"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END").alias("overlap_pct"),
        label.alias("label"),
        F.expr("CAST(0.37 AS DOUBLE) + (CAST(round(l_extendedprice * 100, 0) AS BIGINT) % 6300) / CAST(10000.0 AS DOUBLE)").alias("confidence"),
        F.expr("CAST(l_partkey % 4 AS BIGINT)").alias("tile_x"),
        F.expr("CAST(l_orderkey % 4 AS BIGINT)").alias("tile_y"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 640L ELSE 480L END").alias("stride"),
        F.expr("CAST((l_partkey * 7919 + l_orderkey * 31) % 560 AS BIGINT)").alias("px"),
        F.expr("CAST((l_orderkey * 104729 + l_suppkey * 13) % 560 AS BIGINT)").alias("py"),
        F.expr("CAST(20 + l_partkey % 40 AS BIGINT)").alias("w"),
        F.expr("CAST(20 + l_orderkey % 40 AS BIGINT)").alias("h"),
    )
    rows = rows.withColumns({"x_correct": F.expr("tile_x * stride"), "y_correct": F.expr("tile_y * stride")})
    rows = rows.withColumns({"x1": F.expr("px + x_correct"), "y1": F.expr("py + y_correct"), "x2": F.expr("px + w + x_correct"), "y2": F.expr("py + h + y_correct")})
    rows = rows.withColumns({"cx": F.expr("(x1 + x2) / 2.0D"), "cy": F.expr("(y1 + y2) / 2.0D")})
    return rows.select("det_id", "slide_id", "overlap_pct", "label", "confidence", "x1", "y1", "x2", "y2", "cx", "cy", "x_correct", "y_correct", "tile_x", "tile_y")
