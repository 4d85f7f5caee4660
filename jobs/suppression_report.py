"""What the choice of a suppression rule does to each slide's class composition: a report for a study's detections.

Reads a table of detections (Parquet; or the order lines that the repository derives test detections from), applies the
configured variants in one pass, and writes ``<output>``, partitioned by overlap:

    slide_id, nms_method, Mac, Lym, Neu, Eos (survivors), pct_* (percentages), retained (share of the reference's survivors),
    alr_* (log-ratios to the reference class, zeros replaced), diff_* (from the reference method's), low_*, high_*, within
    (all differences inside the margin; null where a log-ratio is missing), overlap_pct

A row without a slide is the study's: counts of all slides, diff_* the median of the slides' differences, low_* and high_*
its 90 % interval by the bootstrap, and within the verdict, whether all intervals lie inside the margin (null for the
reference method; no interval and not within under three slides). On slides' rows low_* and high_* are null.

A run replaces the partitions of the overlaps it has, so it can be repeated, and a study can be reported overlap by overlap
(``overlaps`` in the configuration; null: all). Labels other than the study's are left out.

    python -m jobs.suppression_report --detections PATH --output PATH [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessella.config import CONFIG
from tessella.operators import counts, inference, suppress
from tessella.sources import fixture, validate
from tessella.sources.scratch import cut, discard

NAME = "suppression_report"
log = logging.getLogger(f"jobs.{NAME}")
KEYS = ["slide_id", "overlap_pct", "nms_method"]
SHORT = list(CONFIG.short)
OTHERS = [s for k, s in enumerate(SHORT) if k != CONFIG.reference]
REPORT = (
    "slide_id string, nms_method string, " + ", ".join(f"{s} long" for s in SHORT) + ", " + ", ".join(f"pct_{s} double" for s in SHORT) + ", retained double, "
    + ", ".join(f"{p}_{s} double" for p in ("alr", "diff", "low", "high") for s in OTHERS) + ", within boolean, overlap_pct double"
)


def detections(spark: SparkSession, path: str, overlaps: list[float] | None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = fixture.derived(rows) if "l_orderkey" in rows.columns else rows
    rows = validate.known_labels(rows)
    return rows if overlaps is None else rows.where(F.col("overlap_pct").isin(*map(float, overlaps)))


def report(cells: DataFrame, config: dict) -> DataFrame:
    """The report from survivors' counts: a row a slide, overlap and method, and one an overlap and method for the study."""
    mine = config["reference"]
    ratios = inference.log_ratios(cells, strength=config["strength"]).select(*KEYS, *(f"alr_{s}" for s in OTHERS))
    base = ratios.where(F.col("nms_method") == mine).select("slide_id", "overlap_pct", *(F.col(f"alr_{s}").alias(f"base_{s}") for s in OTHERS))
    slides = cells.join(ratios, KEYS, "left").join(base, ["slide_id", "overlap_pct"], "left")
    slides = slides.withColumns({f"diff_{s}": F.col(f"alr_{s}") - F.col(f"base_{s}") for s in OTHERS} | {f"{p}_{s}": F.lit(None).cast("double") for p in ("low", "high") for s in OTHERS})
    slides = shares(slides, ["slide_id", "overlap_pct"], mine)
    reals = [*(f"pct_{s}" for s in SHORT), "retained", *(f"{p}_{s}" for p in ("alr", "diff", "low", "high") for s in OTHERS)]
    slides = common.rounded(slides, reals, config["digits"])
    inside = F.greatest(*(F.when(F.col(f"diff_{s}").isNotNull(), F.abs(f"diff_{s}")) for s in OTHERS)) <= config["margin"]
    slides = slides.withColumn("within", inside)

    differences = inference.differences(inference.long_ratios(ratios), mine)
    tested = inference.equivalence(differences, ["overlap_pct", "nms_method", "coord"], margin=config["margin"])
    of = lambda c, s: F.max(F.when(F.col("coord") == f"alr_{s}", F.col(c)))
    wide = [of(c, s).alias(f"{p}_{s}") for p, c in (("diff", "median"), ("low", "ci_low"), ("high", "ci_high")) for s in OTHERS]
    tested = tested.groupBy("overlap_pct", "nms_method").agg(*wide, F.bool_and("equivalent").alias("within"))
    study = cells.groupBy("overlap_pct", "nms_method").agg(*(F.sum(s).alias(s) for s in SHORT)).join(tested, ["overlap_pct", "nms_method"], "left")
    study = study.withColumns({"slide_id": F.lit(None).cast("string")} | {f"alr_{s}": F.lit(None).cast("double") for s in OTHERS})
    study = common.rounded(shares(study, ["overlap_pct"], mine), reals, config["digits"])
    columns = ["slide_id", "nms_method", *SHORT, *reals, "within", "overlap_pct"]
    return slides.select(*columns).unionByName(study.select(*columns))


def shares(rows: DataFrame, unit: list[str], reference: str) -> DataFrame:
    """Adds each class's percentage and the share of the reference method's survivors in the same unit."""
    n = rows.where(F.col("nms_method") == reference).select(*unit, counts.total().alias("n"))
    whole = counts.total().cast("double")
    return rows.join(n, unit).withColumns(
        {f"pct_{s}": F.coalesce(F.try_divide(F.col(s) * 100.0, whole), F.lit(0.0)) for s in SHORT} | {"retained": F.try_divide(whole, F.col("n").cast("double"))}
    )


def run(spark: SparkSession, source: str, output: str, config: dict | None = None) -> dict:
    """Write the report; returns the numbers that are logged."""
    config = config or common.config(NAME)
    chosen = {m: suppress.REGISTRY[m] for m in dict.fromkeys([config["reference"], *config["variants"]])}
    dets = cut(detections(spark, source, config["overlaps"]), "report-detections")
    n = dets.count()
    log.info("%d detections read from %s", n, source)
    cells = cut(counts.cells(suppress.survivors(dets, chosen), chosen), "report-cells")
    made = cut(report(cells, config), "report")
    writer = made.repartition("overlap_pct").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("overlap_pct").parquet(output.rstrip("/"))
    written = made.count()
    log.info("%d rows written to %s", written, output)
    discard(dets, cells, made)
    return {"read": n, "written": written}


def read(spark: SparkSession, output: str) -> DataFrame:
    """The report as it stands, of all overlaps."""
    return common.stored(spark, output.rstrip("/"), REPORT)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog=f"jobs.{NAME}", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--detections", required=True, help="table of detections, or of order lines, Parquet")
    parser.add_argument("--output", required=True)
    parser.add_argument("--config", help="JSON file with settings that differ from the defaults")
    args = parser.parse_args(argv)
    with common.session(NAME) as spark:
        run(spark, args.detections, args.output, common.config(NAME, args.config))
    return 0


if __name__ == "__main__":
    sys.exit(main())
