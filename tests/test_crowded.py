"""What keeps crowded slides small and fast: tile groups, shared results, the table of kept, lean counting."""

import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from tessella.operators import kernels, suppress
from tessella.plans import catalogue
from tessella.plans import study as studies


def frame(n, seed, tiles=3):
    rng = np.random.default_rng(seed)
    tx, ty = rng.integers(0, tiles, n), rng.integers(0, tiles, n)
    x, y, w, h = tx * 480 + rng.integers(0, 200, n), ty * 480 + rng.integers(0, 200, n), rng.integers(20, 60, n), rng.integers(20, 60, n)
    return pd.DataFrame({"slide_id": "s", "overlap_pct": 0.25, "det_id": np.arange(n), "label": rng.choice(["Makrophage", "Lymphozyt"], n), "confidence": rng.integers(37, 100, n) / 100,
                         "x1": x, "y1": y, "x2": x + w, "y2": y + h, "cx": x + w / 2, "cy": y + h / 2, "x_correct": tx * 480, "y_correct": ty * 480, "tile_x": tx, "tile_y": ty})


def test_variants_inside_tiles_are_grouped_by_tile(spark):
    df = spark.createDataFrame(frame(900, 1))
    some = {k: v for k, v in suppress.SWEEPS.items() if k in ("none_c0.37", "iou_c0.60", "iou_c0.37", "nn_center_k2", "nn_center_c0.60", "nn_dist_r20", "nn_cluster_c0.50")}
    by_tile = suppress.survivors(df, some)
    plan = by_tile._jdf.queryExecution().executedPlan().toString()
    assert all("tile_x" in keys and "tile_y" in keys for keys in re.findall(r"Exchange hashpartitioning\((slide_id[^)]*)\)", plan) if "label" not in keys) and "tile_x" in plan
    group = suppress.Group(frame(900, 1))
    masks = dict(by_tile.select("det_id", "mask").collect())
    for k, v in enumerate(some.values()):
        assert {d for d, m in masks.items() if m >> k & 1} == set(group.frame["det_id"].to_numpy()[group.survivors(v)].tolist())


@pytest.mark.parametrize("family", ["iou", "nn_dist", "nn_center", "nn_cluster"])
def test_a_block_of_all_tiles_is_the_slide_and_is_solved_once(family):
    group = suppress.Group(frame(700, 2))
    every = group.survivors(suppress.Variant(family, "global"))
    assert all(group.survivors(suppress.Variant(family, f"grid_n{n}")) is every for n in (3, 4, 5))
    fresh = suppress.Group(frame(700, 2))
    fresh.tiles = None  # block by block
    assert (fresh.survivors(suppress.Variant(family, "grid_n4")) == every).all()


@pytest.mark.parametrize("threshold", [None, 0.3, 0.45, 0.6])
def test_table_of_kept(threshold):
    df = frame(1500, 3, tiles=1)
    group = suppress.Group(df)
    v = suppress.Variant("nn_dist") if threshold is None else suppress.Variant("iou", iou=threshold)
    near, part = group.near(v, group.confidence >= 0), group.label.copy() if threshold is None else np.zeros(len(df), np.int64)
    kept = kernels.keep(near, part, np.arange(700))
    nodes = np.arange(700, 1500)
    i, j = (a.ravel() for a in np.meshgrid(nodes, kept, indexing="ij"))
    want = (near.test(i, j) & (part[i] == part[j])).reshape(len(nodes), len(kept)).any(1)
    found, every = kernels.met(near, part, kept, nodes)
    assert found.any() and not (found & ~want).any() and (kernels.struck(near, part, kept, nodes) == want).all()
    assert every == (threshold is None) and (not every or (found == want).all())


def test_counting_candidates_takes_little_memory():
    rng = np.random.default_rng(4)
    x, y = rng.random(200_000) * 2000, rng.random(200_000) * 2000
    tracemalloc.start()
    found = kernels.near_count(x, y, 20.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(int(np.maximum(b - a, 0).sum()) for a, b in kernels._near_runs(x, y, 20.0)[1]) and peak < 70 * len(x)


def test_thresholds_alone_hold_no_group(spark):
    df = frame(300, 3).assign(confidence=lambda d: d["confidence"].where(d.index > 2, [np.nan, 0.37, 0.7] + [0] * 297))
    some = {k: v for k, v in suppress.SWEEPS.items() if k.startswith("none_c")}
    masked = suppress.survivors(spark.createDataFrame(df).withColumn("confidence", F.when(F.col("det_id") != 3, F.col("confidence"))), some, isolate=True)
    assert "Arrow" not in masked._jdf.queryExecution().executedPlan().toString()
    assert masked.columns == ["slide_id", "overlap_pct", "det_id", "label", "tile_x", "tile_y", "mask", "errors"] and masked.where("errors is not null").isEmpty()
    group = suppress.Group(df.assign(confidence=df["confidence"].where(df.index != 3, np.nan)))
    got = dict(masked.select("det_id", "mask").collect())
    for k, v in enumerate(some.values()):
        assert {d for d, m in got.items() if m >> k & 1} == set(group.frame["det_id"].to_numpy()[group.survivors(v)].tolist())


@pytest.mark.parametrize("name, prefix", [("center_k_sweep", "nn_center_k"), ("cluster_radius_sweep", "nn_cluster_r"), ("center_confidence_sweep", "nn_center_c"), ("cluster_confidence_sweep", "nn_cluster_c"), ("confidence_sweep", "none_c")])
def test_a_sweep_solves_its_own_settings_only(spark, monkeypatch, name, prefix):
    asked = []
    monkeypatch.setattr(suppress, "survivors", lambda dets, variants=None, real=suppress.survivors: asked.append(list(variants)) or real(dets, variants))
    monkeypatch.setattr(studies, "_STUDIES", {})
    rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    mine = [n for n in suppress.SWEEPS if n.startswith(prefix)]
    assert asked == [mine] and {r.setting for r in rows.select("setting").distinct().collect()} == set(mine)
