"""Crowded groups in chunks: the same survivors as of the whole, without the whole in memory."""

import gc
import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tests.test_crowded import frame
from tessella.operators import kernels, stream, suppress
from tessella.operators.suppress import REGISTRY, SWEEPS, Variant


def masks(df, variants, chunk, message=None):
    """Survivors' masks by det_id, and errors."""
    df = df.sort_values(["confidence", "det_id"], ascending=[False, True]).assign(tiles=df[["tile_x", "tile_y"]].max().max() + 1, least_tile=df[["tile_x", "tile_y"]].min().min())
    group, radii = suppress.Group(df), {}
    for v in variants.values():
        if v.family == "nn_center":
            radii[v.center_k, v.confidence] = name = f"radius_{v.center_k}_{v.confidence}"
            df[name] = group.radius(v.center_k, group.confidence >= v.confidence)
    made = stream.Stream(list(variants.values()), radii, message)
    for at in range(0, len(df), chunk):
        made.take(pa.Table.from_pandas(df.iloc[at : at + chunk], preserve_index=False))
    rows = [r for part in made.rows() for r in pa.table(part).to_pylist()]
    assert len(rows) == len(df) and {(r["det_id"], r["label"], r["tile_x"], r["tile_y"]) for r in rows} == set(df[["det_id", "label", "tile_x", "tile_y"]].itertuples(index=False, name=None))
    return {r["det_id"]: r["mask"] for r in rows}, made


@pytest.mark.parametrize("variants", [REGISTRY, SWEEPS], ids=["registry", "sweeps"])
@pytest.mark.parametrize("shift, tiles, chunk", [(0, 5, 61), (0, 3, 400), (-2, 4, 61)])
def test_chunks_agree_with_the_whole(monkeypatch, variants, shift, tiles, chunk):
    monkeypatch.setattr(kernels, "BASE", 50)
    df = frame(700, 7, tiles)
    df[["tile_x", "tile_y"]] += shift
    df.loc[5, ["x2", "y2"]] = df.loc[5, ["x1", "y1"]].to_numpy()  # a box without area overlaps nothing
    got, made = masks(df, variants, chunk)
    group = suppress.Group(df)
    ids = group.frame["det_id"].to_numpy()
    for k, (name, v) in enumerate(variants.items()):
        assert {d for d, m in got.items() if m >> k & 1} == set(ids[group.survivors(v)].tolist()), name


def test_a_failing_variant_stops_no_other_chunk():
    some = {"none": REGISTRY["none"], "broken": Variant("iou", "grid_nx"), "cluster": Variant("nn_cluster", "grid_nx"), "iou_grid_n2": REGISTRY["iou_grid_n2"]}
    got, made = masks(frame(300, 8), some, 90, suppress.message)
    assert sorted(made.errors) == [1, 2] and all("ValueError" in e for e in made.errors.values())
    assert not any(m >> k & 1 for m in got.values() for k in (1, 2)) and any(m >> 3 & 1 for m in got.values())
    with pytest.raises(ValueError):
        masks(frame(300, 8), some, 90)


def test_pass_takes_crowded_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(stream, "CROWDED", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    df = pd.concat([frame(500, 9), frame(120, 10).assign(slide_id=None)])
    df["det_id"] = np.arange(len(df))
    dets = spark.createDataFrame(df)
    some = {m: REGISTRY[m] for m in ("none", "iou_grid_n2", "nn_center_grid_n1", "nn_dist_global", "nn_cluster_grid_n3")}
    masked = suppress.survivors(dets, some)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("confidence") and "DESC" in plan[plan.index("Sort [") :].split("\n")[0]  # groups come in order of priority
    got = dict(masked.select("det_id", "mask").collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(df)
    for _, part in df.groupby("slide_id", dropna=False):
        group = suppress.Group(part)
        ids = group.frame["det_id"].to_numpy()
        for k, v in enumerate(some.values()):
            assert {d for d in ids.tolist() if got[d] >> k & 1} == set(ids[group.survivors(v)].tolist())


def test_a_stream_holds_little_of_what_it_took():
    """Rows that nothing keeps leave 42 bytes each."""
    df = frame(4000, 11, tiles=1)
    _, made = masks(df, {"iou_global": REGISTRY["iou_global"]}, 500)
    assert made.kept is None and not made.columns
    radii, made = {}, stream.Stream([REGISTRY["iou_global"], REGISTRY["nn_cluster_global"]], {})
    df = df.sort_values(["confidence", "det_id"], ascending=[False, True]).assign(tiles=1, least_tile=0)
    for at in range(0, len(df), 500):
        made.take(pa.Table.from_pandas(df.iloc[at : at + 500], preserve_index=False))
    assert len(made.kept["x"]) < 1500 and sum(a.nbytes for parts in made.columns.values() for a in parts) == 42 * len(df)


def given(df, variants, chunk):
    """Survivors' masks by det_id where rows are given out after each chunk, the most rows held after one, and the stream."""
    df = df.sort_values(["confidence", "det_id"], ascending=[False, True]).assign(tiles=df[["tile_x", "tile_y"]].max().max() + 1, least_tile=df[["tile_x", "tile_y"]].min().min())
    made, parts, held = stream.Stream(list(variants.values()), {}), [], 0
    for at in range(0, len(df), chunk):
        made.take(pa.Table.from_pandas(df.iloc[at : at + chunk], preserve_index=False))
        parts += made.ready()
        held = max(held, sum(len(a) for a in made.columns["mask"]))
    centres = sum(part[1] for c in made.centres.values() for part in c.parts.values())
    parts += made.rows()
    rows = [r for part in parts for r in pa.table(part).to_pylist()]
    assert len(rows) == len(df) == len({r["det_id"] for r in rows})
    return {r["det_id"]: r["mask"] for r in rows}, held, centres


CLUSTERS = {f"{s}_{r}_{c}": Variant("nn_cluster", s, confidence=c, distance=r) for s in ("grid_n1", "grid_n2", "grid_n3", "global") for r, c in ((20.0, 0.44), (12.5, 0.44), (0.0, 0.5), (20.0, 0.6))} | {"iou": REGISTRY["iou_grid_n2"]}


@pytest.mark.parametrize("shift, tiles, chunk, n", [(0, 4, 131, 1500), (0, 2, 700, 3000), (-2, 4, 131, 1500)])
def test_rows_given_out_by_chunk_agree_with_the_whole(monkeypatch, shift, tiles, chunk, n):
    monkeypatch.setattr(stream, "THIN", 20)
    df = frame(n, 12, tiles)
    df[["tile_x", "tile_y"]] += shift
    got, _, _ = given(df, CLUSTERS, chunk)
    group = suppress.Group(df)
    ids = group.frame["det_id"].to_numpy()
    for k, (name, v) in enumerate(CLUSTERS.items()):
        assert {d for d, m in got.items() if m >> k & 1} == set(ids[group.survivors(v)].tolist()), name


def test_what_a_stream_holds_does_not_follow_its_rows(monkeypatch):
    """On one area, eight times the rows leave fewer than twice as many held, and fewer than three times the centres."""
    monkeypatch.setattr(stream, "THIN", 500)
    some = {m: REGISTRY[m] for m in ("none", "nn_dist_global", "nn_cluster_grid_n2", "nn_cluster_global")}
    (_, few, less), (_, many, more) = (given(frame(n, 13, 1), some, 2000) for n in (20_000, 160_000))
    assert many < 2 * few and many < 2000 and more < 3 * less


def test_arrays_of_a_chunk_go_without_a_search_for_cycles(monkeypatch):
    monkeypatch.setattr(kernels, "BASE", 50)
    boxes = kernels.Boxes(frame(400, 14, 1)[["x1", "y1", "x2", "y2"]].to_numpy(), 0.45)
    gone = weakref.ref(boxes)
    gc.collect()
    gc.disable()
    try:
        kernels.keep(boxes, np.zeros(400, np.int64), np.arange(400))
        del boxes
        assert gone() is None
    finally:
        gc.enable()
