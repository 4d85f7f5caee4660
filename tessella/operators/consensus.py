"""Per-block consensus of methods by geometric median, and each method's deviation from it.

A block has a row for each method (31 at most); blocks with as many methods are solved together, as one stacked array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import CONFIG, Config
from tessella.functions import compositional as comp
from tessella.operators.counts import BLOCK

ROUNDS, STEP, SAME = 200, 1e-7, 1e-12
RIDGE, FLOOR = 1e-3, 1e-6


def geometric_medians(x: np.ndarray) -> np.ndarray:
    """Weiszfeld's iteration for a stack of blocks (blocks, points, coordinates), from the coordinate-wise medians.

    Points at the estimate weigh nothing; a block is done once it moves less than STEP, or has all points at the estimate.
    """
    if not x.shape[1]:
        raise ValueError("no points")
    y = np.median(x, axis=1)
    open_ = np.arange(len(x)) if x.shape[1] > 1 else np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        if not len(open_):
            break
        away = np.linalg.norm(x[open_] - y[open_, None], axis=2)
        use = away > SAME
        some = use.any(1)
        open_, away, use = open_[some], away[some], use[some]
        w = np.where(use, 1 / np.where(use, away, 1), 0.0)
        nearer = np.einsum("bm,bmd->bd", w, x[open_]) / w.sum(1)[:, None]
        moved = np.linalg.norm(nearer - y[open_], axis=1)
        y[open_] = nearer
        open_ = open_[moved >= STEP]
    return y


def geometric_median(x: np.ndarray) -> np.ndarray:
    return geometric_medians(x[None])[0]


def leave_one_out(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Mahalanobis distance of each point to its block's centre, by the covariance of the block's others, regularised.

    ``x`` is a stack (blocks, points, coordinates), or one block. The covariances come from one by taking each point's
    part out. With too few others the distance is Euclidean; a covariance that can't be inverted is pseudo-inverted.
    """
    if x.ndim == 2:
        return leave_one_out(x[None], center[None])[0]
    _, m, d = x.shape
    gap = x - center[:, None]
    if m - 1 <= d:
        return np.linalg.norm(gap, axis=2)
    dev = x - x.mean(1, keepdims=True)
    cross = np.einsum("bmi,bmj->bij", dev, dev)[:, None] - m / (m - 1) * dev[..., :, None] * dev[..., None, :]
    cov = cross / (m - 2)
    scale = np.maximum(np.trace(cov, axis1=2, axis2=3) / d, 0)
    cov += (RIDGE * scale + FLOOR)[..., None, None] * np.eye(d)
    try:
        solved = np.linalg.solve(cov, gap[..., None])[..., 0]
    except np.linalg.LinAlgError:
        solved = (np.linalg.pinv(cov) @ gap[..., None])[..., 0]
    return np.sqrt(np.maximum(0, (gap * solved).sum(2)))


def deviations(panel: DataFrame) -> DataFrame:
    """Block keys, method, the consensus (c1..), and Aitchison and Mahalanobis distances to it; blocks of two methods and more."""
    z = [c for c in panel.columns if c[0] == "z" and c[1:].isdigit()]

    columns = [*BLOCK, "nms_method", *(f"c{k}" for k in range(1, len(z) + 1)), "aitchison_distance", "mahalanobis_distance"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*BLOCK, "nms_method"], ignore_index=True)
        own = pdf.groupby(BLOCK, sort=False)["nms_method"].transform("size").to_numpy()
        out = [pd.DataFrame(columns=columns)]
        for m in np.unique(own[own > 1]):  # blocks with as many methods make one stack
            part = pdf[own == m].reset_index(drop=True)
            x = part[z].to_numpy(float).reshape(-1, m, len(z))
            center = geometric_medians(x)
            part = part[[*BLOCK, "nms_method"]].copy()
            for k in range(len(z)):
                part[f"c{k + 1}"] = np.repeat(center[:, k], m)
            part["aitchison_distance"] = np.linalg.norm(x - center[:, None], axis=2).ravel()
            part["mahalanobis_distance"] = leave_one_out(x, center).ravel()
            out.append(part[columns])
        return out[-1] if len(out) < 3 else pd.concat(out[1:])

    keys = "slide_id string, overlap_pct double, block_size long, block_x long, block_y long, nms_method string"
    schema = f"{keys}, {', '.join(f'c{k} double' for k in range(1, len(z) + 1))}, aitchison_distance double, mahalanobis_distance double"
    # many blocks a group: whole blocks, dealt evenly, and few enough for one task
    bucket = F.pmod(F.xxhash64("block_x", "block_y"), F.lit(64))
    return panel.withColumn("_bucket", bucket).groupBy("slide_id", "overlap_pct", "block_size", "_bucket").applyInPandas(lambda pdf: run(pdf.drop(columns="_bucket")), schema)


def block_consensus(deviation: DataFrame, block_counts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """The consensus as additive log-ratios, the number of methods in it, and the block's total under the mask method."""
    z = sorted(c for c in deviation.columns if c[0] == "c" and c[1:].isdigit())
    rows = deviation.groupBy(*BLOCK).agg(*(F.first(c).alias(c) for c in z), F.count(F.lit(1)).alias("n_methods_in_consensus"))
    ratios = comp.alr(comp.ilr_inverse([F.col(c) for c in z]), config.reference)
    names = [s for k, s in enumerate(config.short) if k != config.reference]
    totals = block_counts.where(F.col("nms_method") == config.mask_method).select(*BLOCK, "n_block_total")
    rows = rows.select(*BLOCK, *(r.alias(f"consensus_alr_{n}") for r, n in zip(ratios, names, strict=True)), "n_methods_in_consensus")
    return rows.join(totals, BLOCK, "left")


def method_deviation(deviation: DataFrame) -> DataFrame:
    return deviation.select(*BLOCK, "nms_method", "aitchison_distance", "mahalanobis_distance")
