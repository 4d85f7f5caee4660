import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.config import METHODS, SCOPES
from tessella.operators import fixpoint, kernels, suppress
from tessella.operators.suppress import REGISTRY, Group, Variant


def frame(rows, label="Makrophage"):
    """rows: (x1, y1, x2, y2, confidence[, tile_x, tile_y[, label]])"""
    out = []
    for k, r in enumerate(rows):
        x1, y1, x2, y2, conf, *rest = r
        tx, ty = rest[:2] if len(rest) > 1 else (0, 0)
        out.append((k, "s", 0.0, rest[2] if len(rest) > 2 else label, conf, x1, y1, x2, y2, (x1 + x2) / 2, (y1 + y2) / 2, tx * 640, ty * 640, tx, ty))
    columns = ["det_id", "slide_id", "overlap_pct", "label", "confidence", "x1", "y1", "x2", "y2", "cx", "cy", "x_correct", "y_correct", "tile_x", "tile_y"]
    return pd.DataFrame(out, columns=columns)


def kept(df, variant):
    g = Group(df)
    return set(g.frame["det_id"].to_numpy()[g.survivors(variant)].tolist())


def random_frame(n, seed, tiles=3, size=200):
    r = np.random.default_rng(seed)
    tx, ty = r.integers(0, tiles, n), r.integers(0, tiles, n)
    x, y = tx * size + r.integers(0, size, n), ty * size + r.integers(0, size, n)
    w, h = r.integers(20, 60, n), r.integers(20, 60, n)
    conf = np.round(r.uniform(0.40, 0.6, n), 2)
    labels = r.choice(["Makrophage", "Lymphozyt"], n)
    return frame(list(zip(x.tolist(), y.tolist(), (x + w).tolist(), (y + h).tolist(), conf.tolist(), tx.tolist(), ty.tolist(), labels.tolist(), strict=True)))


def slow(df, variant):
    """The rules by definition: one detection after the other, one block after the other."""
    df = df[df["confidence"] >= variant.confidence].sort_values(["confidence", "det_id"], ascending=[False, True]).reset_index(drop=True)
    rows = df.to_dict("records")
    radius = {}
    for label, part in df.groupby("label"):
        side = ((part.x2 - part.x1) + (part.y2 - part.y1)) / 2
        radius[label] = variant.center_k * side.std() if len(part) > 1 else 0
    if variant.family == "iou_edgecrop":
        rows = [r for r in rows if r["x1"] - r["x_correct"] > 5 and r["y1"] - r["y_correct"] > 5 and r["x2"] - r["x_correct"] < 635 and r["y2"] - r["y_correct"] < 635]

    def conflict(a, b):
        if variant.family.startswith("iou"):
            w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
            both = max(w, 0) * max(h, 0)
            return both / ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - both) >= variant.iou
        limit = radius[a["label"]] if variant.family == "nn_center" else variant.distance
        d = np.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"])
        return a["label"] == b["label"] and limit > 0 and d <= limit

    def solve(some):
        if variant.family == "nn_cluster":
            comp = list(range(len(some)))
            for i in range(len(some)):
                for j in range(i):
                    if conflict(some[i], some[j]) and comp[i] != comp[j]:
                        a, b = comp[i], comp[j]
                        comp = [min(a, b) if c in (a, b) else c for c in comp]
            first = {}
            for k, c in enumerate(comp):
                first.setdefault(c, k)
            return [some[k] for k in first.values()]
        out = []
        for r in some:
            if not any(conflict(r, o) for o in out):
                out.append(r)
        return out

    if variant.scope == "global":
        return {r["det_id"] for r in solve(rows)}
    if variant.scope == "grid_n1":
        return {r["det_id"] for t in {(r["tile_x"], r["tile_y"]) for r in rows} for r in solve([x for x in rows if (x["tile_x"], x["tile_y"]) == t])}
    n, alive = int(variant.scope[-1]), rows
    top = max((r["tile_x"] for r in rows), default=0), max((r["tile_y"] for r in rows), default=0)
    for by in range(0, top[1] + 1, n - 1):
        for bx in range(0, top[0] + 1, n - 1):
            inside = [r for r in alive if bx <= r["tile_x"] < bx + n and by <= r["tile_y"] < by + n]
            good = {r["det_id"] for r in solve(inside)}
            gone = {r["det_id"] for r in inside} - good
            alive = [r for r in alive if r["det_id"] not in gone]
    return {r["det_id"] for r in alive}


@pytest.mark.parametrize("method", METHODS)
def test_every_variant_against_its_definition(method):
    for seed in range(3):
        df = random_frame(140, seed)
        assert kept(df, REGISTRY[method]) == (set(df[df.confidence >= 0.44].det_id) if method == "none" else slow(df, REGISTRY[method])), (method, seed)


@pytest.mark.parametrize("method", METHODS)
def test_invariants(method):
    v = REGISTRY[method]
    assert kept(frame([]), v) == set()
    assert kept(frame([(100, 100, 130, 130, 0.9)]), v) == {0}
    df = random_frame(200, 9)
    assert kept(df, v) <= kept(df, REGISTRY["none"]) and kept(df, v) == kept(df.sample(frac=1, random_state=1), v)


def test_overlap_values():
    a, b = np.array([[0, 0, 10, 10]]), np.array([[5, 0, 15, 10]])
    assert kernels.iou(a, b)[0] == pytest.approx(50 / 150)
    assert kernels.iou(a, a)[0] == 1 and kernels.iou(a, a + 20)[0] == 0 and kernels.iou(a * 0, a * 0)[0] == 0


def test_chains():
    chain = frame([(x, 0, x + 10, 10, c) for x, c in ((0, 0.9), (15, 0.8), (30, 0.7))])
    assert kept(chain, Variant("nn_cluster")) == {0}  # one component
    assert kept(chain, Variant("nn_dist")) == {0, 2}  # the middle one falls, the last one stays


def test_edges_are_strict():
    boxes = [(6, 6, 30, 30), (5, 6, 30, 30), (6, 5, 30, 30), (600, 6, 635, 30), (6, 600, 30, 635), (600, 600, 634, 634), (0, 0, 20, 20)]
    df = frame([(*b, 0.9 - k / 100) for k, b in enumerate(boxes)])
    assert kept(df, Variant("iou_edgecrop", iou=1.1)) == {0, 5}


def test_distance_is_inclusive_and_labels_are_apart():
    two = [(0, 0, 10, 10, 0.9), (20, 0, 30, 10, 0.8)]
    assert kept(frame(two), Variant("nn_dist")) == {0}
    assert kept(frame([two[0], (*two[1], 0, 0, "Lymphozyt")]), Variant("nn_dist")) == {0, 1}
    same = frame([(0, 0, 10, 10, 0.9), (0, 0, 10, 10, 0.8, 0, 0, "Lymphozyt")])
    assert kept(same, Variant("iou")) == {0} and kept(same, Variant("iou_classwise")) == {0, 1}
    assert kept(frame([(0, 0, 10, 10, 0.9), (1, 0, 11, 10, 0.8)]), Variant("nn_center")) == {0, 1}  # equal boxes: radius 0


def test_scale_of_clusters():
    r = np.random.default_rng(0)
    x, y = r.uniform(0, 8000, 100_000), r.uniform(0, 8000, 100_000)
    i, j = kernels.distance_conflicts(x, y, np.zeros(100_000, int), np.full(100_000, 20.0))
    alive = np.ones(100_000, bool)
    kernels.cluster(alive, i, j)
    assert 0 < alive.sum() < 100_000


def mixed_boxes(n, seed, span=300, empty=0.05):
    """Boxes of sides from 1 to 512, some of them flat, some without area."""
    r = np.random.default_rng(seed)
    w = (2 ** r.uniform(0, 9, n)).astype(int) * (r.random(n) > empty)
    h = np.where(r.random(n) < 0.7, w, (2 ** r.uniform(0, 9, n)).astype(int))
    x, y = r.integers(-span, span, n), r.integers(-span, span, n)
    return np.c_[x, y, x + w, y + h]


def overlapping(boxes, threshold):
    i, j = np.triu_indices(len(boxes), 1)
    hit = kernels.iou(boxes[i], boxes[j]) >= threshold
    return sorted(zip(i[hit].tolist(), j[hit].tolist()))


@pytest.mark.parametrize("threshold", [0.02, 0.1, 0.45, 0.5, 0.9, 1.0])
def test_boxes_of_all_sizes_meet(threshold):
    for seed in range(10):
        boxes = mixed_boxes(150, seed)
        i, j = kernels.iou_conflicts(boxes, threshold)
        assert sorted(zip(i.tolist(), j.tolist())) == overlapping(boxes, threshold), seed
    with pytest.raises(ValueError, match="above 0"):
        kernels.iou_conflicts(boxes, 0.0)


@pytest.mark.parametrize("threshold", [0.1, 0.45, 1.0])
def test_joins_find_the_same_boxes(spark, threshold):
    boxes = mixed_boxes(300, 8)
    df = frame([(*b, 0.99 - k / 1000) for k, b in enumerate(boxes.tolist())])
    edges = fixpoint.iou_edges(spark.createDataFrame(df), threshold)
    assert sorted((r.killer, r.victim) for r in edges.collect()) == overlapping(boxes, threshold)


def test_centres_meet_on_grids_of_their_own_radius(spark):
    df = random_frame(200, 5)
    df.loc[0, ["x2", "y2"]] += 5000  # widens the radius of one label alone
    group = Group(df)
    i, j = group.conflicts(REGISTRY["nn_center_global"], group.confidence > 0)
    ids = group.frame["det_id"].to_numpy()
    edges = fixpoint.center_edges(spark.createDataFrame(df), 2.0).collect()
    assert sorted((r.killer, r.victim) for r in edges) == sorted(zip(ids[i].tolist(), ids[j].tolist())) and edges


def test_one_large_box_costs_the_others_nothing(spark):
    r = np.random.default_rng(0)
    n, side = 100_000, r.integers(20, 60, 100_000)
    x, y = r.integers(0, 20_000, n), r.integers(0, 20_000, n)
    boxes = np.c_[x, y, x + side, y + side]
    boxes[7] = [0, 0, 20_000, 20_000]
    began = time.perf_counter()
    i, j = kernels.iou_conflicts(boxes, 0.45)
    assert time.perf_counter() - began < 1
    rows = spark.range(n).select(F.col("id").alias("det_id"), F.lit("s").alias("slide_id"), F.lit(0.0).alias("overlap_pct"))
    made = spark.createDataFrame(pd.DataFrame(np.c_[np.arange(n), boxes], columns=["det_id", "x1", "y1", "x2", "y2"]))
    rows = rows.join(made, "det_id").withColumns({"confidence": F.lit(0.9), "cx": F.lit(0.0), "cy": F.lit(0.0)})
    edges = fixpoint.iou_edges(rows, 0.45).toPandas()
    assert sorted(zip(edges.killer, edges.victim)) == sorted(zip(i.tolist(), j.tolist()))


def test_registry():
    assert len(REGISTRY) == 31 and list(REGISTRY) == list(METHODS)
    assert suppress.with_parameters("iou_global", iou=0.6).iou == 0.6


@pytest.mark.parametrize("scope", SCOPES)
def test_fixpoint_agrees_with_kernel(spark, scope):
    df = random_frame(300, 4)
    df = df[df.confidence >= 0.44]
    dets = spark.createDataFrame(df)
    boxes = fixpoint.survivors(dets, fixpoint.iou_edges(dets, 0.45), scope)
    assert {r.det_id for r in boxes.collect()} == kept(df, Variant("iou", scope))
    near = fixpoint.survivors(dets, fixpoint.distance_edges(dets, 20.0), scope)
    assert {r.det_id for r in near.collect()} == kept(df, Variant("nn_dist", scope))


def test_one_pass_over_groups(spark):
    df = pd.concat([random_frame(80, 1), random_frame(90, 2).assign(slide_id="t")])
    masked = suppress.survivors(spark.createDataFrame(df))
    assert masked.count() == 170
    for m in ("iou_grid_n2", "nn_center_global"):
        got = suppress.survived(masked, m).where("slide_id = 't'").collect()
        assert {r.det_id for r in got} == kept(df[df.slide_id == "t"], REGISTRY[m])


@pytest.mark.parametrize("method", ["nn_center_grid_n2", "nn_cluster_grid_n1", "nn_cluster_grid_n3", "nn_cluster_global", "iou_edgecrop_grid_n3"])
def test_joins_agree_with_kernel(spark, method):
    df = random_frame(200, 6)
    df.loc[0, ["x2", "y2"]] += 400  # boxes of any size meet
    got = fixpoint.by_variant(spark.createDataFrame(df), REGISTRY[method])
    assert {r.det_id for r in got.collect()} == kept(df, REGISTRY[method])


def test_joins_settle_all_variants_of_a_scope_at_once(spark, monkeypatch):
    df = random_frame(150, 12)
    more = {"iou_c0.50": Variant("iou", "grid_n2", confidence=0.5), "center_c0.50": Variant("nn_center", "grid_n1", confidence=0.5), "classwise": Variant("iou_classwise", "grid_n2"), "cluster_c0.50": Variant("nn_cluster", "grid_n1", confidence=0.5)}
    some = {m: v for m, v in REGISTRY.items() if v.scope in ("grid_n1", "grid_n2", "global")} | more
    calls = []
    for name in ("dead_bits", "_graph_edges"):
        monkeypatch.setattr(fixpoint, name, lambda *a, f=getattr(fixpoint, name), name=name: calls.append(name) or f(*a))
    got = {r.det_id: r["mask"] for r in fixpoint.masks(spark.createDataFrame(df), some).collect()}
    group = Group(df)
    ids = group.frame["det_id"].to_numpy()
    for k, (name, v) in enumerate(some.items()):
        assert {i for i, m in got.items() if m >> k & 1} == set(ids[group.survivors(v)].tolist()), name
    assert calls.count("dead_bits") == 3 and calls.count("_graph_edges") == 5  # a loop a scope; a table a rule and parameter


def test_large_groups_are_solved_by_joins(spark):
    big = random_frame(120, 3)
    small = random_frame(30, 4).assign(slide_id="t")
    small["det_id"] += 1000
    some = {m: REGISTRY[m] for m in ("none", "iou_grid_n2", "nn_cluster_grid_n1")}
    dets = spark.createDataFrame(pd.concat([big, small]))
    whole = suppress.survivors(dets, some)
    split = suppress.survivors(dets, some, most=50)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) and whole.count() == 150


def test_crowded_groups_list_no_conflicts_and_keep_the_same(monkeypatch):
    df = random_frame(180, 5, tiles=4, size=90)
    variants = REGISTRY | suppress.SWEEPS
    listed = {n: kept(df, v) for n, v in variants.items()}
    monkeypatch.setattr(kernels, "LISTED", -1)
    monkeypatch.setattr(kernels, "BASE", 20)
    monkeypatch.setattr(kernels, "STEP", 50)
    assert {n: kept(df, v) for n, v in variants.items()} == listed


def test_a_crowded_slide_takes_memory_by_its_detections():
    r = np.random.default_rng(0)
    n = 30_000
    x, y, w, h = r.integers(0, 300, n), r.integers(0, 300, n), r.integers(20, 60, n), r.integers(20, 60, n)
    df = frame(list(zip(x.tolist(), y.tolist(), (x + w).tolist(), (y + h).tolist(), r.uniform(0.44, 1, n).tolist(), strict=True)))
    tracemalloc.start()
    sizes = [len(kept(df, REGISTRY[m])) for m in ("iou_global", "nn_dist_grid_n2", "nn_center_global", "nn_cluster_global")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes[3] == 1 and max(sizes) < 15_000
    assert peak < 600 * 2**20  # listed, the overlapping boxes alone took gigabytes


@pytest.mark.parametrize("scope", ["grid_n1", "grid_n2", "grid_n3", "global"])
def test_waves_agree_with_kernel_and_write_no_conflicts(spark, monkeypatch, scope):
    df = random_frame(260, 8, tiles=5, size=70)
    some = {m: v for m, v in REGISTRY.items() if v.scope == scope and v.family != "none"}
    written = []
    monkeypatch.setattr(fixpoint, "cut", lambda t, name, f=fixpoint.cut: written.append(t.columns) or f(t, name))
    got = {r.det_id: r.alive for r in fixpoint.by_waves(spark.createDataFrame(df), scope, some).collect()}
    for k, (name, v) in enumerate(some.items()):
        assert {i for i, m in got.items() if m >> k & 1} == kept(df, v), name
    assert not any("killer" in c for c in written)
    near = {m: v for m, v in some.items() if v.family in ("nn_center", "nn_cluster")}  # each label by itself
    assert {r.det_id for r in fixpoint.by_waves(spark.createDataFrame(df), scope, near).collect()} == set().union(*(kept(df, v) for v in near.values()))
    one = fixpoint.by_variant(spark.createDataFrame(df), near[f"nn_center_{scope}"])
    assert {r.det_id for r in one.collect()} == kept(df, REGISTRY[f"nn_center_{scope}"]) and not any("killer" in c for c in written)
