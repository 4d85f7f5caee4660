"""Command line: python -m tessella.cli --store DIR COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.config import METHODS, METHODS_25
from tessella.operators import suppress
from tessella.plans import jobs
from tessella.sources.store import Store

STAGES = ("run", "blocks", "consensus", "outliers", "weighted-summary", "baseline", "timing", "method-similarity", "plots", "export-counts")


def stage(store: Store, name: str, args) -> None:
    out = args.results
    if name == "run":
        print(f"{jobs.run(store)} slices suppressed")
    elif name == "blocks":
        jobs.blocks(store)
    elif name == "consensus":
        tables = jobs.consensus_tables(store, METHODS if args.all_methods else METHODS_25, args.min_cells)
        jobs.export(tables, out)
        worst = jobs.largest(tables["zero_sensitivity"], F.abs("gap"))
        if worst:
            print(f"largest gap of alpha {worst.gap:.3f} ({worst.alpha_as_is:.3f} to {worst.alpha_common_scale:.3f}) at block size {worst.block_size}, overlap {worst.overlap_pct:.3f}")
        best = jobs.largest(tables["scale_dependence_curve"], F.col("alpha"))
        if best:
            print(f"largest alpha {best.alpha:.4f} at block size {best.block_size}, overlap {best.overlap_pct:.3f}")
    elif name == "outliers":
        tables = jobs.outlier_tables(store)
        jobs.export(tables, out)
        for r in tables["outlier_summary"].where("frac_settings_flagged > 0.05").orderBy("nms_method").collect():
            print(f"{r.nms_method}: flagged in {r.n_settings_flagged} of {r.n_settings_total} settings")
    elif name == "weighted-summary":
        jobs.export(jobs.weighted_summary(store), out)
    elif name == "baseline":
        tables = jobs.baseline(store, args.reference)
        jobs.export(tables, out)
        for r in tables["verdicts"].orderBy("overlap_pct").collect():
            print(f"overlap {r.overlap_pct}: all equivalent {r.all_equivalent}, {args.reference} equivalent {r.reference_equivalent}")
    elif name == "timing":
        jobs.export(jobs.timing(store, args.slides, args.repeats), out)
    elif name == "method-similarity":
        jobs.export(jobs.method_similarity(store), out)
    elif name == "export-counts":
        jobs.export(jobs.slide_counts(store), out)
    elif name == "plots":
        jobs.export(jobs.plot_tables(store), out)
    elif name == "benchmark":
        dets = store.read("raw_detections").where(f"overlap_pct = {args.overlap}")
        dets = dets.join(jobs.representative(dets, 1), "slide_id", "left_semi")
        kept = jobs.counts.cells(suppress.survivors(dets)).select("nms_method", jobs.counts.total().alias("survivors"))
        jobs.times(dets, repeats=1).join(kept, "nms_method").select("nms_method", "elapsed_cpu", "survivors").orderBy("nms_method").show(len(METHODS), False)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella", description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the study's tables")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init-db", help="create missing tables")
    commands.add_parser("status", help="rows of each table")
    load = commands.add_parser("load", help="load detections")
    load.add_argument("--images", required=True)
    load.add_argument("--data", required=True)
    load.add_argument("--slide")
    nms = commands.add_parser("nms", help="suppression and analysis")
    nms.add_argument("stage", choices=[*STAGES, "benchmark", "all"])
    nms.add_argument("--results", default="results")
    nms.add_argument("--min-cells", type=int)
    nms.add_argument("--all-methods", action="store_true", help="31 variants instead of 25")
    nms.add_argument("--reference", default="iou_grid_n1")
    nms.add_argument("--slides", type=int, default=5)
    nms.add_argument("--repeats", type=int, default=3)
    nms.add_argument("--overlap", type=float, default=0.0)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    store, failed = Store(spark, args.store), 0
    if args.command == "init-db":
        store.init()
    elif args.command == "status":
        for name, n in store.status().items():
            print(f"{name}: {'(missing)' if n is None else n}")
    elif args.command == "load":
        done = jobs.load(store, args.images, args.data, args.slide)
        print(", ".join(f"{v} {k}" for k, v in done.items() if k != "errors"))
        for (slide, overlap), reason in sorted(done["errors"].items()):
            print(f"{slide} at {overlap}: {reason}")
    elif args.stage == "all":
        for name in STAGES:  # a stage that fails does not stop the others
            try:
                stage(store, name, args)
            except Exception:
                failed += 1
                print(f"{name} failed", file=sys.stderr)
                traceback.print_exc()
    else:
        stage(store, args.stage, args)
    return min(failed, 1)


if __name__ == "__main__":
    sys.exit(main())
