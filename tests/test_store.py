import pytest
from pyspark.sql import functions as F
from test_suppress import random_frame

from tessella.operators import suppress
from tessella.operators.suppress import REGISTRY, Variant
from tessella.plans import jobs
from tessella.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, f"file://{tmp_path}/store")
    made.init()
    a, b = random_frame(60, 1), random_frame(50, 2).assign(slide_id="t", overlap_pct=0.25)
    b["det_id"] += 1000
    for part in (a, b):
        made.write("raw_detections", spark.createDataFrame(part))
    return made


def rows(store, name, *drop):
    return sorted(map(tuple, store.read(name).drop(*drop).collect()), key=repr)


def test_runs_of_some_variants_add_to_what_is_there(store):
    some = {m: REGISTRY[m] for m in ("none", "iou_grid_n1", "nn_cluster_grid_n2")}
    one = {"iou_loose": Variant("iou", "grid_n1", iou=0.2)}
    assert jobs.run(store, some) == 2
    before = {name: rows(store, name) for name in ("cell_counts", "tile_counts", "checkpoint")}
    assert jobs.run(store, one) == 2
    for name, old in before.items():
        assert set(old) < set(rows(store, name))
    assert store.read("cell_counts").select("nms_method").distinct().count() == 4 and store.read("checkpoint").count() == 8
    assert jobs.run(store, some | one) == 0
    more = some | one | {"nn_dist_global": REGISTRY["nn_dist_global"]}
    assert jobs.run(store, more) == 2 and store.read("cell_counts").count() == 2 * 5 * 4
    whole = Store(store.spark, store.root + "-at-once")
    whole.write("raw_detections", store.read("raw_detections"))
    jobs.run(whole, more)
    for name in ("cell_counts", "tile_counts"):
        assert rows(store, name) == rows(whole, name)
    jobs.blocks(store)
    blocks = rows(store, "block_counts")
    jobs.blocks(store)
    assert rows(store, "block_counts") == blocks


def test_only_what_a_unit_lacks_is_done(store, spark, monkeypatch):
    some = {m: REGISTRY[m] for m in ("none", "iou_grid_n1", "nn_dist_grid_n1")}
    jobs.run(store, {"none": some["none"]})
    late = random_frame(30, 3).assign(slide_id="u")
    late["det_id"] += 5000
    store.write("raw_detections", spark.createDataFrame(late))
    asked = []
    passing = suppress.survivors
    monkeypatch.setattr(suppress, "survivors", lambda dets, variants, **k: asked.append((dets.select("slide_id").distinct().count(), sorted(variants))) or passing(dets, variants, **k))
    assert jobs.run(store, some) == 3
    assert sorted(asked) == [(1, ["iou_grid_n1", "nn_dist_grid_n1", "none"]), (2, ["iou_grid_n1", "nn_dist_grid_n1"])]


@pytest.mark.parametrize("most", [suppress.MOST, 55])  # with and without a slide that is solved by joins
def test_a_variant_that_fails_stops_no_other(store, monkeypatch, most):
    passing = suppress.survivors
    monkeypatch.setattr(suppress, "survivors", lambda dets, variants, **k: passing(dets, variants, most, **k))
    some = {"none": REGISTRY["none"], "broken": Variant("iou", "grid_nx"), "iou_grid_n1": REGISTRY["iou_grid_n1"]}
    assert jobs.run(store, some) == 2
    marks = {(r.slide_id, r.nms_method): (r.status, r.error_msg) for r in store.read("checkpoint").collect()}
    assert {m: s for (slide, m), (s, _) in marks.items() if slide == "s"} == {"none": "done", "broken": "error", "iou_grid_n1": "done"}
    assert all("ValueError" in e for (_, m), (_, e) in marks.items() if m == "broken") and len(marks) == 6
    assert {r.nms_method for r in store.read("cell_counts").collect()} == {"none", "iou_grid_n1"}
    asked = []
    monkeypatch.setattr(suppress, "survivors", lambda dets, variants, **k: asked.append(list(variants)) or passing(dets, variants, most, **k))
    assert jobs.run(store, some | {"broken": Variant("iou", "grid_n2")}) == 2 and asked == [["broken"]]
    assert {r.status for r in store.read("checkpoint").collect()} == {"done"}
    with pytest.raises(Exception, match="grid_nx|invalid literal"):
        passing(store.read("raw_detections"), {"broken": Variant("iou", "grid_nx")}).collect()


@pytest.mark.parametrize("name", ["cell_counts", "tile_counts", "slides", "timing", "checkpoint", "method_deviation"])
def test_a_write_that_is_cut_short_leaves_the_table(store, spark, name):
    kinds = {f.name: f.dataType for f in store.read(name).schema}

    def frame(n, value):
        made = {"slide_id": F.concat(F.lit("s"), (F.col("id") % 7).cast("string")), "overlap_pct": (F.col("id") % 2) / 4.0, "nms_method": F.concat(F.lit("m"), (F.col("id") % 3).cast("string")), "status": F.lit(f"v{value}")}
        return spark.range(n).select(*(made.get(c, F.lit(None if k.typeName() in ("string", "timestamp") else value)).cast(k).alias(c) for c, k in kinds.items()))

    store.write(name, frame(40, 1).distinct())
    before = rows(store, name)
    fails = F.udf(lambda x: 1 / 0 if x == "s3" else x)
    with pytest.raises(Exception, match="division"):
        store.write(name, frame(40, 2).distinct().withColumn("slide_id", fails("slide_id")))
    assert rows(store, name) == before and before
    store.write(name, frame(40, 2).distinct())
    assert len(rows(store, name)) == len(before) and rows(store, name) != before
