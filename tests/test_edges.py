"""All conflicts of a table, found block by block: each once, from few rows and few candidates, and never held as a whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import fixpoint, kernels


def frame(n, seed, span=500, low=20, high=60):
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(-span, span, n), rng.integers(-span, span, n), rng.integers(low, high, n), rng.integers(low, high, n)
    return pd.DataFrame({"slide_id": rng.choice(["s", "t"], n), "overlap_pct": 0.25, "det_id": rng.permutation(n), "label": rng.choice(["a", "b"], n), "confidence": rng.integers(44, 60, n) / 100,
                         "x1": x, "y1": y, "x2": x + w, "y2": y + h, "cx": x + w / 2, "cy": y + h / 2})


def brute(df, keys, near):
    df = df.sort_values(["confidence", "det_id"], ascending=[False, True]).reset_index(drop=True)
    i, j = np.triu_indices(len(df), 1)
    hit = near(df, i, j)
    for k in keys:
        hit &= df[k].to_numpy()[i] == df[k].to_numpy()[j]
    ids = df["det_id"].to_numpy()
    return sorted(zip(ids[i[hit]].tolist(), ids[j[hit]].tolist()))


def pairs(edges):
    return sorted((r.killer, r.victim) for r in edges.collect())


@pytest.mark.parametrize("room", [1, 300, 100_000])
def test_conflicts_by_blocks(spark, monkeypatch, room):
    monkeypatch.setattr(fixpoint, "ROOM", room)
    monkeypatch.setattr(fixpoint, "BATCH", 50)
    monkeypatch.setattr(kernels, "STEP", 100)
    df = pd.concat([frame(500, 1), frame(60, 2, low=1, high=700).assign(det_id=lambda d: d["det_id"] + 500)])
    dets = spark.createDataFrame(df)
    boxes = lambda d, i, j: kernels.iou(*(d[["x1", "y1", "x2", "y2"]].to_numpy()[k] for k in (i, j))) >= 0.3
    found = pairs(fixpoint.iou_edges(dets, 0.3))
    assert len(found) > 30 and found == brute(df, ["slide_id"], boxes)
    within = lambda d, i, j: (d["cx"].to_numpy()[i] - d["cx"].to_numpy()[j]) ** 2 + (d["cy"].to_numpy()[i] - d["cy"].to_numpy()[j]) ** 2 <= 400
    found = pairs(fixpoint.distance_edges(dets, 20.0))
    assert len(found) > 30 and found == brute(df, ["slide_id", "label"], within)


def test_odd_rows_have_no_conflicts(spark):
    df = frame(6, 3).assign(slide_id="s", label="a", x1=0, y1=0, x2=10, y2=10, cx=5.0, cy=5.0)
    df["confidence"] = [0.5, 0.5, float("nan"), 0.9, 0.5, 0.5]
    df["det_id"] = [1, 2, 3, 4, 5, 5]
    odd = spark.createDataFrame(df).withColumn("cx", F.when(F.col("det_id") == 4, float("nan")).otherwise(F.col("cx"))).withColumn("slide_id", F.when(F.col("det_id") != 2, F.col("slide_id")))
    odd = odd.withColumn("confidence", F.when(F.col("det_id") == 3, float("nan")).otherwise(F.col("confidence")))
    assert pairs(fixpoint.distance_edges(odd, 20.0)) == [(1, 5), (1, 5), (3, 1), (3, 5), (3, 5)]  # NaN is Spark's largest number; a row does not meet its like
    assert pairs(fixpoint.iou_edges(odd, 0.45)) == [(1, 5), (1, 5), (3, 1), (3, 4), (3, 5), (3, 5), (4, 1), (4, 5), (4, 5)]


def test_few_rows_are_dealt_and_few_candidates_tested(spark, monkeypatch):
    df = frame(4000, 4).assign(slide_id="s", label="a")
    rows = spark.createDataFrame(df).selectExpr("cx AS px", "cy AS py")
    dealt = fixpoint._dealt(rows, F.lit(20.0 * fixpoint.BLOCK), F.lit(20.0), F.lit(True))
    assert dealt.where("own").count() == 4000 and dealt.count() < 1.4 * 4000  # joined on bins, each detection stood for six
    tested = []
    part, own = np.zeros(4000, np.int64), np.ones(4000, bool)
    for near, most in ((kernels.Boxes(df[["x1", "y1", "x2", "y2"]].to_numpy(), 0.45), 6), (kernels.Disks(df["cx"].to_numpy(), df["cy"].to_numpy(), part, np.full(4000, 20.0)), 2)):
        real = near.test
        monkeypatch.setattr(near, "test", lambda i, j, real=real: tested.append(len(i)) or real(i, j))
        tested.clear()
        found = sum(len(i) for i, _ in kernels.meetings(near, part, own))
        assert found > 1000 and sum(tested) < most * found
