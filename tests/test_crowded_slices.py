"""Timing and waves of crowded slices: rows come by priority and in chunks, and no task holds a slice."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tessella.operators import fixpoint, stream, suppress
from tessella.plans import jobs


def frame(n, seed, tiles=3):
    rng = np.random.default_rng(seed)
    tx, ty = rng.integers(0, tiles, n), rng.integers(0, tiles, n)
    x, y, w, h = tx * 480 + rng.integers(0, 120, n), ty * 480 + rng.integers(0, 120, n), rng.integers(20, 60, n), rng.integers(20, 60, n)
    return pd.DataFrame({"slide_id": "s", "overlap_pct": 0.25, "det_id": np.arange(n), "label": rng.choice(["Makrophage", "Lymphozyt"], n), "confidence": rng.integers(37, 100, n) / 100,
                         "x1": x, "y1": y, "x2": x + w, "y2": y + h, "cx": x + w / 2, "cy": y + h / 2, "x_correct": tx * 480, "y_correct": ty * 480, "tile_x": tx, "tile_y": ty})


@pytest.mark.parametrize("crowded", [60, 10_000])
def test_times_take_a_slice_in_chunks(spark, monkeypatch, crowded):
    monkeypatch.setattr(stream, "CROWDED", crowded)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    some = {m: suppress.REGISTRY[m] for m in ("none", "iou_grid_n1", "iou_edgecrop_grid_n2", "nn_dist_grid_n3", "nn_center_grid_n2", "nn_cluster_grid_n2", "nn_cluster_global")}
    try:
        spent = jobs.times(spark.createDataFrame(pd.concat([frame(300, 1), frame(200, 2).assign(slide_id="t")])), some, repeats=2)
        rows = spent.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.slide_id, r.nms_method, r.repeat) for r in rows) == sorted((s, m, k) for s in "st" for m in some for k in (0, 1))
    assert {(r.slide_id, r.overlap_pct, r.n_detections) for r in rows} == {("s", 0.25, 300), ("t", 0.25, 200)}
    assert all(r.elapsed_cpu >= 0 and r.elapsed_wall > 0 for r in rows)
    plan = spent._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan


def chunked(df, size):
    df = df.sort_values(["confidence", "det_id"], ascending=[False, True])
    return [pa.Table.from_pandas(df.iloc[k : k + size], preserve_index=False) for k in range(0, len(df), size)]


def test_a_chunk_can_be_solved_again_on_a_copy():
    df = frame(400, 3).assign(tiles=3, least_tile=0)
    for name in ("iou_grid_n2", "nn_dist_global", "nn_cluster_grid_n2"):
        once, often = (stream.Stream([suppress.REGISTRY[name]], {}) for _ in range(2))
        for table in chunked(df, 150):
            once.take(table)
            often.read(table)
            for flow in (often.copy(), often.copy(), often):
                flow.solve()
        often.copy().settle()
        masks = [dict(zip(c["det_id"].tolist(), c["mask"].tolist())) for c in (once.settle(), often.settle())]
        assert masks[0] == masks[1]
        group = suppress.Group(df)
        assert {d for d, m in masks[0].items() if m} == set(group.frame["det_id"].to_numpy()[group.survivors(suppress.REGISTRY[name])].tolist())


def test_waves_take_blocks_in_chunks(spark):
    df = frame(500, 4)
    some = {m: suppress.REGISTRY[m] for m in ("iou_global", "nn_dist_global", "nn_cluster_global")}
    group = suppress.Group(df)
    want = {m: set(group.frame["det_id"].to_numpy()[group.survivors(v)].tolist()) for m, v in some.items()}
    waves = fixpoint.by_waves(spark.createDataFrame(df), "global", some)
    plan = waves._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "InPandas" not in plan
    got = dict(waves.collect())
    alive = sum(np.where(df["confidence"] >= v.confidence, 1 << k, 0) for k, v in enumerate(some.values()))
    flow, given, held = stream.Stream(list(some.values()), {}, carry=("confidence", "cx", "cy")), {}, 0
    for table in chunked(df.assign(alive=alive), 90):
        flow.take(table)
        for c in flow.ready():
            given |= dict(zip(c["det_id"].to_pylist(), c["mask"].to_pylist()))
        held = sum(len(a) for a in flow.columns["cx"])
    for c in flow.rows():
        given |= dict(zip(c["det_id"].to_pylist(), c["mask"].to_pylist()))
        at = df.set_index("det_id").loc[c["det_id"].to_pylist()]
        assert c["cx"].to_pylist() == at["cx"].tolist() and c["label"].to_pylist() == at["label"].tolist()
    assert held < 400 and 0 not in given.values()
    for k, m in enumerate(some):
        assert {d for d, b in got.items() if b >> k & 1} == {d for d, b in given.items() if b >> k & 1} == want[m]
