"""Duplicate suppression: variants, their registry, and one grouped pass that applies any number of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, METHODS, Config, family_scope
from tessella.operators import kernels
from tessella.operators import stream as streams


@dataclass(frozen=True)
class Variant:
    """A rule, the scope it works in, and its parameters."""

    family: str
    scope: str = "global"
    confidence: float = CONFIG.confidence
    iou: float = CONFIG.iou
    distance: float = CONFIG.distance
    center_k: float = CONFIG.center_k
    edge: int = CONFIG.edge
    tile: int = CONFIG.tile


def _registry() -> dict[str, Variant]:
    return {m: Variant("none") if m == "none" else Variant(*family_scope(m)) for m in METHODS}


#: The 31 registered variants by name. Further ones can be added; a run takes any dict of variants.
REGISTRY: dict[str, Variant] = _registry()

THRESHOLDS, RADII = (0.37, 0.44, 0.50, 0.60, 0.70), (10, 15, 20, 30, 40)
#: Every parameter setting of the study, inside tiles: detector threshold for each rule, and each rule's own parameter.
SWEEPS: dict[str, Variant] = {
    **{f"iou_t{t:.2f}": Variant("iou", "grid_n1", iou=t) for t in (0.30, 0.45, 0.60)},
    **{f"{f}_r{r}": Variant(f, "grid_n1", distance=float(r)) for f in ("nn_dist", "nn_cluster") for r in RADII},
    **{f"nn_center_k{k}": Variant("nn_center", "grid_n1", center_k=float(k)) for k in (1, 2, 3)},
    **{f"none_c{c:.2f}": Variant("none", confidence=c) for c in THRESHOLDS},
    **{f"{f}_c{c:.2f}": Variant(f, "grid_n1", confidence=c) for f in ("iou", "nn_dist", "nn_center", "nn_cluster") for c in THRESHOLDS},
    "iou_classwise": Variant("iou_classwise", "grid_n1"),
}


def interior(config: Config = CONFIG):
    """Boxes more than ``edge`` pixels inside their tile."""
    e, far = config.edge, config.tile - config.edge
    return (
        (F.col("x1") - F.col("x_correct") > e) & (F.col("y1") - F.col("y_correct") > e)
        & (F.col("x2") - F.col("x_correct") < far) & (F.col("y2") - F.col("y_correct") < far)
    )


def center_radii(dets: DataFrame, k: float = CONFIG.center_k) -> DataFrame:
    """Per (slide, overlap, label): k standard deviations of the mean box side; 0 for a single box."""
    side = ((F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1"))) / 2.0
    radius = F.coalesce(F.stddev_samp(side) * k, F.lit(0.0))
    return dets.groupBy("slide_id", "overlap_pct", "label").agg(radius.alias("radius"))


OUTPUT = ["slide_id", "overlap_pct", "det_id", "label", "tile_x", "tile_y"]


class Group:
    """The detections of one slide and overlap, in order of priority, with their conflicts as far as they are needed."""

    def __init__(self, pdf: pd.DataFrame | pa.Table, radii: dict[tuple, str] | None = None):
        """``radii`` names columns of radii by k and confidence, for a part of a slide; columns that no rule asks for may be absent."""
        self.order = order = np.lexsort((pdf["det_id"].to_numpy(), -pdf["confidence"].to_numpy()))
        known = pdf.column_names if isinstance(pdf, pa.Table) else pdf.columns
        self.frame = pdf[OUTPUT].iloc[order] if isinstance(pdf, pd.DataFrame) else None
        get = lambda c, kind: pdf[c].to_numpy()[order].astype(kind, copy=False) if c in known else np.zeros(len(order), kind)
        self.radii = {k: get(c, float) for k, c in (radii or {}).items()}
        self.confidence = get("confidence", float)
        self.boxes = self._stack(get, "x1", "y1", "x2", "y2")
        self.x, self.y = get("cx", float), get("cy", float)
        label = pdf["label"]
        label = label.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if isinstance(pdf, pa.Table) else pd.factorize(label)[0]
        self.label = label.astype(np.int64)[order]
        self.tx, self.ty = get("tile_x", np.int64), get("tile_y", np.int64)
        self.at = self._stack(get, "x_correct", "y_correct")
        self.known: dict[tuple, tuple] = {}
        self.done: dict[Variant, np.ndarray] = {}
        inside = len(self.tx) > 0 and self.tx.min() >= 0 and self.ty.min() >= 0
        self.tiles = max(int(self.tx.max()), int(self.ty.max())) + 1 if inside else None

    def _stack(self, get, *columns: str) -> np.ndarray:
        out = np.empty((len(self.order), len(columns)), np.int64)
        for k, c in enumerate(columns):
            out[:, k] = get(c, np.int64)
        return out

    def radius(self, k: float, passed: np.ndarray) -> np.ndarray:
        side = ((self.boxes[:, 2] - self.boxes[:, 0]) + (self.boxes[:, 3] - self.boxes[:, 1])) / 2.0
        out = np.zeros(len(side))
        for label in np.unique(self.label[passed]):
            mine = self.label == label
            some = side[mine & passed]
            out[mine] = k * some.std(ddof=1) if len(some) > 1 else 0.0
        return out

    def near(self, v: Variant, passed: np.ndarray) -> kernels.Disks | kernels.Boxes:
        if v.family.startswith("iou"):
            return kernels.Boxes(self.boxes, v.iou, self.label if v.family == "iou_classwise" else None)
        if v.family != "nn_center":
            radius = np.full(len(self.x), float(v.distance))
        else:
            radius = self.radii[v.center_k, v.confidence] if self.radii else self.radius(v.center_k, passed)
        return kernels.Disks(self.x, self.y, self.label, radius)

    def conflicts(self, v: Variant, passed: np.ndarray):
        """The group's conflicts under a variant's rule: a list of pairs (i, j), or where they are many what finds them."""
        key = (v.family == "iou_classwise", v.iou) if v.family.startswith("iou") else ("center", v.center_k, v.confidence) if v.family == "nn_center" else ("distance", v.distance)
        if key not in self.known:
            near, every = self.near(v, passed), np.arange(len(self.x))
            self.known[key] = near if near.candidates(every) > kernels.LISTED else near.within(every)
        return self.known[key]

    def survivors(self, v: Variant, among: np.ndarray | None = None) -> np.ndarray:
        """Which survive a variant; ``among`` are those that take part, if other than the variant itself tells."""
        if v.scope.startswith("grid_n") and v.scope != "grid_n1" and self.tiles and int(v.scope[-1]) >= self.tiles:
            v = replace(v, scope="global")  # the first block has all tiles, and the others find nothing to suppress in what it leaves
        if among is not None:
            return self._survivors(v, among)
        if v not in self.done:
            self.done[v] = self._survivors(v, None)
        return self.done[v]

    def _survivors(self, v: Variant, among: np.ndarray | None) -> np.ndarray:
        if among is None and v.family in ("iou", "iou_classwise", "nn_dist"):
            lower = [w for w in self.done if replace(w, confidence=v.confidence) == v and w.confidence < v.confidence]
            if lower:  # what passes a higher threshold comes first, so it fares as it did among all that pass a lower one
                return self.done[lower[0]] & (self.confidence >= v.confidence)
        alive = self.confidence >= v.confidence if among is None else among
        if v.family == "none" or not alive.any():
            return alive
        found = self.conflicts(v, alive)
        if v.family == "iou_edgecrop" and among is None:
            far = v.tile - v.edge
            alive = alive & (self.boxes[:, :2] - self.at > v.edge).all(1) & (self.boxes[:, 2:] - self.at < far).all(1)
        cluster = v.family == "nn_cluster"
        if isinstance(found, tuple):
            return kernels.by_scope(v.scope, kernels.cluster if cluster else kernels.greedy, *found, self.tx, self.ty, alive)
        return kernels.crowded_by_scope(v.scope, kernels.firsts if cluster else kernels.keep, found, self.tx, self.ty, alive)


#: Detections of a slide and overlap that one task takes. In crowded ones it holds what is kept and what the cluster rule needs, with ``isolate`` 42 bytes of each too.
MOST = 16_000_000
MASK_SCHEMA = "slide_id string, overlap_pct double, det_id long, label string, tile_x long, tile_y long, mask long"


ERRORS = "errors array<struct<nms_method:string,error_msg:string>>"


def message(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _unsuppressed(dets: DataFrame, chosen: list[Variant], isolate: bool) -> DataFrame:
    """Masks of thresholds alone: each row tells for itself, and no group is held."""
    sure = F.when(~F.isnan("confidence"), F.col("confidence"))
    mask = F.lit(0).cast("long")
    for k, v in enumerate(chosen):
        mask = mask + F.when(sure >= v.confidence, F.lit(1 << k).cast("long")).otherwise(0)
    columns = [F.col(c).cast(kind) for c, kind in (x.split() for x in MASK_SCHEMA.split(", ")[:-1])]
    kind = ERRORS.split(" ", 1)[1]
    rows = dets.select(*columns, mask.alias("mask"))
    return rows.withColumn("errors", F.lit(None).cast(kind)) if isolate else rows


def by_priority(rows: DataFrame, dets: DataFrame, radii: dict[tuple, str], key: list[str], groups: int, tiled: bool = False) -> DataFrame:
    """Rows dealt by key and in order of priority, with their label's ``radii`` and the range of tile numbers of their slide (or of their tile), which ``dets`` tell."""
    slide = ["slide_id", "overlap_pct"]

    def beside(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
        few = few.withColumnsRenamed({c: f"its_{c}" for c in keys})
        same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in keys]
        return rows.join(F.broadcast(few), same, "left").drop(*(f"its_{c}" for c in keys))

    # groups are few rows but long work, so partitions are not coalesced by size, and are more than the groups if those are few
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(usual, min(4 * groups, 8 * usual)), *key)
    for (k, confidence), name in radii.items():  # not shuffled: a row a slide, overlap and label
        of = center_radii(dets.where(F.col("confidence") >= confidence), k).withColumnRenamed("radius", name)
        rows = beside(rows, of, [*slide, "label"]).withColumn(name, F.coalesce(name, F.lit(0.0)))
    least, end = F.least("tile_x", "tile_y"), F.greatest("tile_x", "tile_y") + 1
    if tiled:
        rows = rows.withColumns({"least_tile": least, "tiles": end})
    else:
        rows = beside(rows, dets.groupBy(*slide).agg(F.min(least).alias("least_tile"), F.max(end).alias("tiles")), slide)
    return rows.sortWithinPartitions(*key, F.desc("confidence"), "det_id")


def center_names(chosen: list[Variant]) -> dict[tuple, str]:
    """Names of the columns of radii by what the variants ask for."""
    return {(v.center_k, v.confidence): f"radius_{k}" for k, v in enumerate(chosen) if v.family == "nn_center"}


#: What a group's task reads.
INPUT = ["slide_id", "overlap_pct", "det_id", "label", "confidence", "x1", "y1", "x2", "y2", "cx", "cy", "x_correct", "y_correct", "tile_x", "tile_y"]


def survivors(dets: DataFrame, variants: dict[str, Variant] | None = None, most: int = MOST, isolate: bool = False) -> DataFrame:
    """Each detection with ``mask``: bit k is set if it survives the k-th variant. One shuffle for all variants.

    A slide at one overlap is a group: suppression couples all its tiles, and its size is bounded by the image. Where no
    variant looks beyond a tile, a tile is one. A crowded group is taken in chunks (``stream``). Groups of over ``most`` detections, too large for one task, are solved by joins
    with the same result. With ``isolate`` a variant that fails stops no other: its bits are 0 and a row of its group tells in ``errors``.
    """
    names, chosen = list(variants or REGISTRY), list((variants or REGISTRY).values())
    if len(chosen) > 63:
        raise ValueError("at most 63 variants in a pass")
    tiled = all(v.scope == "grid_n1" or v.family == "none" for v in chosen)
    if all(v.family == "none" for v in chosen):
        return _unsuppressed(dets, chosen, isolate)
    radii = center_names(chosen)
    crowded = streams.CROWDED

    def whole(table: pa.Table) -> pa.Table:
        group = Group(table, radii)
        mask, errors = np.zeros(table.num_rows, np.int64), []
        for k in sorted(range(len(chosen)), key=lambda k: chosen[k].confidence):  # low thresholds tell about higher ones
            try:
                mask[group.order] |= group.survivors(chosen[k]).astype(np.int64) << k
            except Exception as e:
                if not isolate:
                    raise
                errors.append({"nms_method": names[k], "error_msg": message(e)})
        return finished(table.select(OUTPUT).append_column("mask", pa.array(mask)), errors)

    def finished(out: pa.Table, errors: list) -> pa.Table:
        kind = pa.list_(pa.struct([("nms_method", pa.string()), ("error_msg", pa.string())]))
        return out.append_column("errors", pa.array([errors or None, *[None] * (out.num_rows - 1)], kind)) if isolate else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's rows, which come in order of priority."""
        held, n, stream = [], 0, None
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > (stream.room() if stream else crowded):
                stream = stream or streams.Stream(chosen, radii, message if isolate else None)
                stream.take(pa.Table.from_batches(held))
                held, n = [], 0
                if not isolate:  # else a variant that fails later takes its bits back
                    for rows in stream.ready():
                        yield from pa.table(rows).to_batches()
        if not stream:
            yield from whole(pa.Table.from_batches(held)).to_batches()
            return
        if held:
            stream.take(pa.Table.from_batches(held))
        errors = []
        for k, rows in enumerate(stream.rows()):
            if not k:
                errors = [{"nms_method": names[v], "error_msg": e} for v, e in stream.errors.items()]
            yield from finished(pa.table(rows), errors if not k else []).to_batches()

    dets, slide = dets.select(*INPUT), ["slide_id", "overlap_pct"]
    key = [*slide, *(["tile_x", "tile_y"] if tiled else [])]
    schema = f"{MASK_SCHEMA}, {ERRORS}" if isolate else MASK_SCHEMA
    sizes = dets.groupBy(*key).count()
    groups, largest = sizes.agg(F.count(F.lit(1)), F.max("count")).first()

    def solved(rows: DataFrame) -> DataFrame:
        return by_priority(rows, dets, radii, key, groups, tiled).groupBy(*key).applyInArrow(run, schema)

    if (largest or 0) <= most:
        return solved(dets)
    from tessella.operators import fixpoint

    large = sizes.where(F.col("count") > most).select(*slide).distinct()  # goes by joins as a whole, with radii of its own
    small = solved(dets.join(large, slide, "left_anti"))
    return small.unionByName(fixpoint.masks(dets.join(large, slide, "left_semi"), dict(zip(names, chosen, strict=True)), isolate))


def survived(masked: DataFrame, name: str, variants: dict[str, Variant] | None = None) -> DataFrame:
    """The rows that survive one variant."""
    bit = 1 << list(variants or REGISTRY).index(name)
    return masked.where(F.col("mask").bitwiseAND(bit) != 0).drop("mask")


def with_parameters(name: str, **changes) -> Variant:
    return replace(REGISTRY[name], **changes)
