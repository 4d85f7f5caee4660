"""The study's jobs on a store: load, suppression, blocks, consensus, outliers, summaries, inference and timing."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, METHODS_25, Config
from tessella.operators import agreement, consensus, counts, inference, outliers, summary, suppress
from tessella.operators import stream as streams
from tessella.operators.suppress import REGISTRY, Variant
from tessella.sources import images, validate
from tessella.sources import load as loading
from tessella.sources.scratch import cut, discard
from tessella.sources.store import Store

KEYS = ["slide_id", "overlap_pct"]
log = logging.getLogger(__name__)


def load(store: Store, images_dir: str, data_dir: str, slide: str | None = None, config: Config = CONFIG) -> dict:
    store.init()
    slides = images.slides(store.spark, images_dir, config)
    if slide:
        slides = slides.where(F.col("slide_id") == slide)
        if slides.isEmpty():
            raise FileNotFoundError(f"no image of slide {slide}")
    return loading.load(store, slides, loading.files(store.spark, data_dir, config), config)


def run(store: Store, variants: dict[str, Variant] | None = None, config: Config = CONFIG) -> int:
    """Suppress and count what the manifest lacks; returns the number of (slide, overlap) units worked on.

    Units that lack the same variants are done in one pass, and only for these. A variant that fails in a unit is marked
    ``error`` with its message, stops no other, and is taken up again by the next run.
    """
    variants = variants or REGISTRY
    units = store.read("raw_detections").select(*KEYS).distinct()
    done = store.read("checkpoint").where("status = 'done'").select(*KEYS, "nms_method")
    lacking = validate.pending(units, list(variants), done).groupBy(*KEYS).agg(F.array_sort(F.collect_list("nms_method")).alias("lacks"))
    todo = cut(lacking, "run-todo")  # a row a unit, with at most all names
    n = todo.count()
    for (names,) in todo.select("lacks").distinct().collect():  # as many as units have different histories
        mine = todo.where(F.col("lacks") == F.array(*map(F.lit, names))).select(*KEYS)
        _count(store, mine, {m: v for m, v in variants.items() if m in names}, config)
    discard(todo)
    return n


def _count(store: Store, units: DataFrame, variants: dict[str, Variant], config: Config) -> None:
    """Suppress the units' detections by the variants, and write counts, then marks."""
    dets = store.read("raw_detections").join(units, KEYS, "left_semi")
    masked = cut(suppress.survivors(dets, variants, isolate=True), "run-masked")
    faults = masked.where("errors is not null").select(*KEYS, F.explode("errors").alias("e")).select(*KEYS, "e.nms_method", F.substring("e.error_msg", 1, 500).alias("error_msg"))
    faults = cut(faults.distinct(), "run-faults")
    good = lambda rows: rows.join(faults.select(*KEYS, "nms_method"), [*KEYS, "nms_method"], "left_anti")
    store.write("cell_counts", counts.long(good(counts.cells(masked, variants, config)), config, rel=True))
    store.write("tile_counts", counts.long(good(counts.tiles(masked, variants, config)), config))
    names = F.explode(F.array(*map(F.lit, variants))).alias("nms_method")
    marks = units.select(*KEYS, names).join(faults, [*KEYS, "nms_method"], "left")
    status = F.when(F.col("error_msg").isNull(), "done").otherwise("error").alias("status")
    store.write("checkpoint", marks.select(*KEYS, "nms_method", status, "error_msg", F.current_timestamp().alias("finished_at")))  # last: what is cut short is done again
    discard(masked, faults)


def wide(rows: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Counts with a row a label as one with a column a label."""
    keys = [c for c in rows.columns if c not in ("label", "count", "rel_count", "n_block_total")]
    labels = [F.sum(F.when(F.col("label") == label, F.col("count")).otherwise(0)).alias(s) for label, s in zip(config.labels, config.short, strict=True)]
    return rows.groupBy(*keys).agg(*labels)


def blocks(store: Store, config: Config = CONFIG) -> None:
    store.write("block_counts", counts.long(counts.blocks(wide(store.read("tile_counts"), config), config), config))


def block_table(store: Store, config: Config = CONFIG) -> DataFrame:
    return wide(store.read("block_counts"), config).withColumn("n_block_total", counts.total(config))


def eligible(store: Store, methods=METHODS_25, min_cells: int | None = None, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    """Block counts of the methods, and those of eligible blocks."""
    table = block_table(store, config).where(F.col("nms_method").isin(*methods))
    return table, counts.masked_blocks(table, min_cells, config)


def consensus_tables(store: Store, methods=METHODS_25, min_cells: int | None = None, config: Config = CONFIG) -> dict[str, DataFrame]:
    """Write consensus and deviations; returns the scale curve and the zero-handling table."""
    table, good = eligible(store, methods, min_cells, config)
    good = cut(good, "consensus-blocks")
    deviation = cut(consensus.deviations(agreement.coordinates(good, config=config)), "consensus-deviations")
    store.write("block_consensus", consensus.block_consensus(deviation, table, config))
    store.write("method_deviation", consensus.method_deviation(deviation))
    return {"scale_dependence_curve": agreement.scale_curve(table, good, len(methods), config), "zero_sensitivity": agreement.zero_sensitivity(good, len(methods), config)}


def largest(rows: DataFrame, by):
    """The row at which ``by`` is largest; None if it is nowhere a number."""
    return rows.where(by.isNotNull() & ~F.isnan(by)).orderBy(by.desc(), *rows.columns[:2]).first()


def outlier_tables(store: Store, config: Config = CONFIG) -> dict[str, DataFrame]:
    cells = outliers.tail_cells(store.read("method_deviation"), config=config)
    flags = cut(outliers.permutation(cells, config), "outlier-flags")
    return {"outlier_flags": flags, "outlier_summary": outliers.summary(flags), "largest_share": outliers.largest_share(store.read("method_deviation")), "sign_test": outliers.sign_test(cells)}


def cell_table(store: Store, config: Config = CONFIG) -> DataFrame:
    return wide(store.read("cell_counts"), config)


def weighted_summary(store: Store, config: Config = CONFIG) -> dict[str, DataFrame]:
    return {"weighted_method_means": summary.weighted_means(cell_table(store, config), config)}


def baseline(store: Store, reference: str = "iou_grid_n1", config: Config = CONFIG) -> dict[str, DataFrame]:
    """Equivalence to no suppression, the verdicts, Friedman's test across methods, and the slides that had to be left out."""
    cells = cell_table(store, config)
    ratios, left_out = inference.log_ratios(cells, config), cut(inference.left_out(cells, config), "baseline-left-out")
    for r in left_out.orderBy("overlap_pct", "nms_method").collect():  # a row an overlap and method at most
        log.warning("overlap %s, %s: %d of %d slides have no detections left, and are left out", r.overlap_pct, r.nms_method, r.n_left_out, r.n_slides)
    tested = cut(inference.equivalence(inference.differences(inference.long_ratios(ratios)), ["overlap_pct", "nms_method", "coord"], config), "baseline")
    ranked = inference.long_ratios(ratios, ["ilr_1", "ilr_2", "ilr_3"])
    return {"equivalence": tested, "verdicts": inference.verdicts(tested, reference), "friedman": inference.friedman(ranked, config), "left_out": left_out}


def method_similarity(store: Store, config: Config = CONFIG) -> dict[str, DataFrame]:
    return {"method_distance_matrix": summary.distance_matrix(cell_table(store, config), config)}


def slide_counts(store: Store) -> dict[str, DataFrame]:
    """Slide counts under pseudonyms."""
    cells = store.read("cell_counts").drop("rel_count")
    return {"slide_counts": summary.pseudonymised(cells, cells)}


def representative(dets: DataFrame, n: int, config: Config = CONFIG) -> DataFrame:
    """n slides, drawn by a seeded hash, among those that have every overlap of the table."""
    overlaps = dets.agg(F.count_distinct("overlap_pct")).first()[0]
    whole = dets.groupBy("slide_id").agg(F.count_distinct("overlap_pct").alias("k")).where(F.col("k") == overlaps)
    return whole.orderBy(F.xxhash64("slide_id", F.lit(config.seed)), "slide_id").limit(n).select("slide_id")


#: Variants whose state a task of ``times`` holds at once.
TIMED = 6


def _clocked(work) -> np.ndarray:
    cpu, wall = time.process_time(), time.perf_counter()
    work()
    return np.array([time.process_time() - cpu, time.perf_counter() - wall])


def times(dets: DataFrame, variants: dict[str, Variant] | None = None, repeats: int = 3) -> DataFrame:
    """CPU and wall time of every variant on each slice, after a warm-up.

    A crowded slice is taken in chunks, as in the pass that counts: each chunk is solved once for every repeat, and the times are
    the sums over chunks. The warm-up is on the first chunk. Tasks on the same slice read one shuffle.
    """
    chosen = dict(variants or REGISTRY)
    names, crowded = suppress.center_names(list(chosen.values())), streams.CROWDED

    def clock(mine: dict[str, Variant]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flows = {n: streams.Stream([v], names if v.family == "nn_center" else {}) for n, v in mine.items()}
            some = next(iter(flows.values()))
            tables = streams.chunks(batches, lambda: some.room() if some.taken else crowded)
            first = next(tables)
            second = next(tables, None)
            key, n = [first[c][0].as_py() for c in KEYS], first.num_rows
            if second is None:
                spent = {m: whole(first, v) for m, v in mine.items()}
            else:
                spent = {m: np.zeros((repeats, 2)) for m in mine}
                take(flows, spent, first, True)
                del first
                while second is not None:
                    n += second.num_rows
                    take(flows, spent, second)
                    second = next(tables, None)
                for m in mine:
                    flow = flows.pop(m)
                    for r in range(repeats):
                        spent[m][r] += _clocked((flow.copy() if r < repeats - 1 else flow).settle)
            out = [(*key, m, r, n, *map(float, spent[m][r])) for m in mine for r in range(repeats)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], columns)

        return run

    def whole(table: pa.Table, v: Variant) -> np.ndarray:
        suppress.Group(table, names).survivors(v)
        return np.array([_clocked(lambda group=suppress.Group(table, names): group.survivors(v)) for _ in range(repeats)])

    def take(flows: dict, spent: dict, table: pa.Table, warm: bool = False) -> None:
        for m, flow in flows.items():
            flow.read(table)
            if warm:
                flow.copy().solve()
            for r in range(repeats):
                spent[m][r] += _clocked((flow.copy() if r < repeats - 1 else flow).solve)
            next(flow.ready(), None)  # lets go of rows that are settled

    schema = "slide_id string, overlap_pct double, nms_method string, repeat int, n_detections long, elapsed_cpu double, elapsed_wall double"
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]
    dets = dets.select(*suppress.INPUT)
    rows = suppress.by_priority(dets, dets, names, KEYS, dets.select(*KEYS).distinct().count())
    parts = -(-len(chosen) // TIMED)
    dealt = [dict(list(chosen.items())[k::parts]) for k in range(parts)]
    return reduce(DataFrame.unionByName, [rows.groupBy(*KEYS).applyInArrow(clock(mine), schema) for mine in dealt])


def timing(store: Store, slides: int = 5, repeats: int = 3, config: Config = CONFIG) -> dict[str, DataFrame]:
    dets = store.read("raw_detections")
    store.write("timing", times(dets.join(representative(dets, slides, config), "slide_id", "left_semi"), repeats=repeats))
    return {"timing_summary": validate.timing_summary(store.read("timing"))}


def plot_tables(store: Store, config: Config = CONFIG) -> dict[str, DataFrame]:
    """What the study's figures show, as tables; drawing is left to other tools."""
    distance = summary.boxes(store.read("method_deviation"), "aitchison_distance", ["overlap_pct", "block_size", "nms_method"])
    spent = summary.boxes(store.read("timing"), "elapsed_cpu", ["nms_method"])
    return {"fig_distance_by_method": distance, "fig_time_by_method": spent, **weighted_summary(store, config)}


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as one CSV file in its own folder; results are small."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")
