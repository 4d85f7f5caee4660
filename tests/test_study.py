import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella import cli
from tessella.config import CONFIG, METHODS
from tessella.operators import counts, inference, outliers, summary
from tessella.plans import jobs
from tessella.plans.study import study
from tessella.sources import images, load, validate
from tessella.sources.store import Store
from tessella.streaming import ingest

SF = "/root/testdata/sf0.001"


def png(path, w, h):
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\0" * 20)


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    """The derived detections written back as tile-relative CSV files, with an image a slide."""
    root = tmp_path_factory.mktemp("study")
    df = study(spark, SF).detections.toPandas()
    (root / "images").mkdir()
    for slide in df.slide_id.unique():
        png(root / "images" / f"{slide}.png", 2560, 2560)
    for (slide, overlap), part in df.groupby(["slide_id", "overlap_pct"]):
        part = part.copy()
        for a in "xy":
            part[f"{a}1"], part[f"{a}2"] = part[f"{a}1"] - part[f"{a}_correct"], part[f"{a}2"] - part[f"{a}_correct"]
        part["note"] = "x"
        folder = root / "data" / load.folder_name(overlap)
        folder.mkdir(parents=True, exist_ok=True)
        part[["note", "label", "confidence", "y1", "x1", "x2", "y2", "x_correct", "y_correct"]].to_csv(folder / f"{slide}.csv", index=False)
    return root


def test_load_run_and_analyse(spark, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    args = ["--store", store.root]
    assert cli.main([*args, "init-db"]) == 0 and store.status()["raw_detections"] == 0
    assert cli.main([*args, "load", "--images", f"{tree}/images", "--data", f"{tree}/data"]) == 0
    base = study(spark, SF).detections
    columns = ["slide_id", "overlap_pct", "label", "confidence", "x1", "y1", "x2", "y2", "cx", "cy", "tile_x", "tile_y"]
    mine = store.read("raw_detections").select(*columns)
    assert mine.count() == base.count() and mine.exceptAll(base.select(*columns)).isEmpty()
    again = jobs.load(store, f"{tree}/images", f"{tree}/data")
    assert again["loaded"] == 0 and again["skipped"] == 16 and again["missing"] == 8 * 9 - 16
    assert cli.main([*args, "nms", "all", "--results", f"{tmp_path}/results", "--min-cells", "20", "--slides", "1", "--repeats", "1"]) == 0
    assert jobs.run(store) == 0  # nothing is left to do
    status = store.status()
    assert status["cell_counts"] == 16 * 31 * 4 and status["checkpoint"] == 16 * 31 and all(n for n in status.values())
    cells = store.read("cell_counts")
    assert cells.where("nms_method = 'none'").agg(F.sum("count")).first()[0] == base.where("confidence >= 0.44").count()
    curve = pd.read_csv(next((tmp_path / "results/scale_dependence_curve").glob("*.csv")))
    assert len(curve) == 12 and (curve.alpha.dropna() <= 1).all()
    store.write("cell_counts", cells.where("slide_id = 'S1'").limit(8))  # only its own partitions are replaced
    assert store.read("cell_counts").select("slide_id").distinct().count() == 8


def test_stream_loads_what_arrives(spark, tree, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest.follow(store, f"{tree}/images", f"{tree}/data", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert store.status()["raw_detections"] == study(spark, SF).detections.count() and store.status()["checkpoint"] == 16 * 31


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        (lambda d: d.drop(columns="x2"), "missing columns: x2"),
        (lambda d: d.assign(x1=d.x1 + 2000, x2=d.x2 + 2000), "already absolute"),
        (lambda d: d.assign(x_correct=d.x_correct + 7), "off the grid"),
        (lambda d: d.assign(x_correct=d.x_correct + 6400), "outside the image"),
        (lambda d: d.assign(x1=d.x1 + 0.5), "whole numbers"),
        (lambda d: d.assign(y_correct=-640), "negative"),
        (lambda d: d.assign(x1=["a", "b"]), "parse"),
    ],
)
def test_bad_files(change, reason):
    good = pd.DataFrame({"label": ["Makrophage", "Unknown"], "confidence": [0.9, 0.9], "x1": [1, 1], "y1": [2, 2], "x2": [30, 30], "y2": [40, 40], "x_correct": [640, 5], "y_correct": [0, 0]})
    one = load.parse(good.to_csv(index=False).encode(), 0.0, 1280, 1280)
    assert len(one) == 1 and one.x1[0] == 641 and one.tile_x[0] == 1 and one.cx[0] == 655.5
    with pytest.raises(ValueError, match=reason):
        load.parse(change(good).to_csv(index=False).encode(), 0.0, 1280, 1280)
    assert load.parse(good.head(0).to_csv(index=False).encode(), 0.0, None, None).empty


def test_a_bad_file_does_not_stop_the_others(spark, tree, tmp_path):
    (tmp_path / "data/0_overlap_raw").mkdir(parents=True)
    (tmp_path / "images").mkdir()
    for slide in ("A", "B"):
        png(tmp_path / "images" / f"{slide}.png", 2560, 2560)
        text = (tree / "data/0_overlap_raw/S1.csv").read_text()
        (tmp_path / f"data/0_overlap_raw/{slide}.csv").write_text(text if slide == "A" else "label\nx\n")
    done = jobs.load(Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/images", f"{tmp_path}/data")
    assert done["loaded"] == 1 and done["failed"] == 1 and "missing" in done["errors"]["B", 0.0]


def test_ids_stay_unique_over_loads_and_any_fault_is_one_files(spark, tree, tmp_path):
    (tmp_path / "data/0_overlap_raw").mkdir(parents=True)
    (tmp_path / "images").mkdir()
    store = Store(spark, f"file://{tmp_path}/store")
    text = (tree / "data/0_overlap_raw/S1.csv").read_text()
    lines = text.split("\n")
    fields = lines[1].split(",")
    bad = ",".join([*fields[:4], "word", *fields[5:]])
    n = 0
    for slide, body in (("A", text), ("B", text), ("C", "\n".join([lines[0], bad, *lines[2:]])), ("D", "\0\xff"), ("E", text)):
        png(tmp_path / "images" / f"{slide}.png", 2560, 2560)
        (tmp_path / f"data/0_overlap_raw/{slide}.csv").write_text(body)
        done = jobs.load(store, f"{tmp_path}/images", f"{tmp_path}/data")
        n += done["rows"]
        assert done["loaded"] == (slide in "ABE") and done["failed"] >= (slide in "CD")
    ids = store.read("raw_detections").select("det_id")
    assert ids.count() == n == ids.distinct().count() and n == 3 * (text.count("\n") - 1)


def test_a_changed_input_makes_a_new_study(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    rows.limit(50).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert study(spark, str(tmp_path)).detections.count() == 50
    assert study(spark, str(tmp_path)) is study(spark, str(tmp_path))
    rows.limit(70).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert study(spark, str(tmp_path)).detections.count() == 70


def test_checks_on_frames(spark):
    d = study(spark, SF).detections
    validate.check_grid(d)
    slides = d.select("slide_id").distinct().withColumns({"image_w": F.lit(2560), "image_h": F.lit(2560)})
    validate.check_bounds(d, slides)
    with pytest.raises(validate.LoadError):
        validate.check_grid(d.withColumn("x_correct", F.col("x_correct") + 3))
    with pytest.raises(validate.LoadError):
        validate.check_bounds(d, slides.withColumn("image_w", F.lit(100)))
    with pytest.raises(validate.LoadError):
        validate.relative_only(d)
    with pytest.raises(validate.LoadError, match="label"):
        validate.require_columns(d.drop("label"), ["label", "x1"])
    assert [CONFIG.stride(o) for o in (0.0, 0.025, 0.25)] == [640, 624, 480]
    assert [load.folder_name(o) for o in (0.05, 0.025, 0.0)] == ["5_overlap_raw", "2.5_overlap_raw", "0_overlap_raw"]


def test_image_headers():
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 700) + struct.pack("<HHII", 257, 3, 1, 500)
    assert images.dimensions(tiff) == (700, 500)
    far = b"MM\0*" + struct.pack(">I", 100_000) + b"\0" * 99_992 + struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 70, 0) + struct.pack(">HHII", 257, 4, 1, 50)
    assert images.dimensions(far) == (70, 50)
    big = b"II+\0\x08\0\0\0" + struct.pack("<Q", 16) + struct.pack("<Q", 2) + struct.pack("<HHQQ", 256, 4, 1, 9) + struct.pack("<HHQQ", 257, 16, 1, 8)
    assert images.dimensions(big) == (9, 8)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\0" * 8
    assert images.dimensions(jpeg) == (40, 30)
    with pytest.raises(ValueError, match="header"):
        images.dimensions(b"no image")


def test_only_headers_are_opened(spark, tmp_path):
    far = b"II*\0" + struct.pack("<I", 100_000) + b"\0" * 99_992 + struct.pack("<H", 2) + struct.pack("<HHII", 256, 4, 1, 700) + struct.pack("<HHII", 257, 4, 1, 500)
    (tmp_path / "a.tif").write_bytes(far)
    (tmp_path / "b.tiff").write_bytes(b"II*\0" + struct.pack("<I", 1 << 30))
    png(tmp_path / "c.png", 3, 4)
    got = {r.slide_id: (r.image_w, r.image_h) for r in images.slides(spark, str(tmp_path)).collect()}
    assert got == {"a": (700, 500), "b": (None, None), "c": (3, 4)}


def test_counts(spark):
    st = study(spark, SF)
    assert st.cells.count() == 16 * 31
    sums = {r.block_size: r.n for r in st.blocks.where("nms_method = 'iou_grid_n2'").groupBy("block_size").agg(F.sum("n_block_total").alias("n")).collect()}
    assert len(set(sums.values())) == 1 and set(sums) == set(CONFIG.block_sizes)  # no cell is lost or doubled
    few = counts.masked_blocks(st.blocks, 30)
    keys = few.select(*counts.BLOCK).distinct().count()
    assert few.where("nms_method = 'none'").count() == keys  # a block once a method, not once a label


def test_slide_without_survivors_counts_zero(spark):
    d = study(spark, SF).detections.limit(5).withColumn("confidence", F.lit(0.1))
    from tessella.operators.suppress import survivors

    masked = survivors(d)
    assert counts.cells(masked).agg(F.sum(counts.total())).first()[0] == 0 and counts.cells(masked).count() >= 31
    assert counts.tiles(masked).isEmpty() and inference.log_ratios(counts.cells(masked)).isEmpty()
    left = inference.left_out(counts.cells(masked)).collect()
    assert len(left) >= 31 and all(r.n_left_out == r.n_slides > 0 for r in left)
    some = spark.createDataFrame([("a", 0.0, "none", 1, 0, 0, 0), ("b", 0.0, "none", 0, 0, 0, 0), ("c", 0.0, "none", None, 0, 0, 0), ("a", 0.0, "iou_global", 0, 3, 0, 0)], "slide_id string, overlap_pct double, nms_method string, Mac long, Lym long, Neu long, Eos long")
    assert [tuple(r) for r in inference.left_out(some).collect()] == [(0.0, "none", 2, 3)]


def cells_of(spark, shift=1.0, slides=12):
    import numpy as np

    r, rows = np.random.default_rng(3), []
    for s in range(slides):
        p = r.dirichlet([6, 6, 2, 1])
        for k, m in enumerate(["none", "iou_grid_n1", "iou_global", "nn_dist_global"]):
            q = p * np.exp(r.normal(0, 0.01, 4))
            q[0] *= shift if m == "nn_dist_global" else 1
            rows.append((f"s{s:02d}", 0.0, m, *(int(x) for x in np.round(1000 * q / q.sum()))))
    return spark.createDataFrame(rows, "slide_id string, overlap_pct double, nms_method string, Mac long, Lym long, Neu long, Eos long")


def test_equivalence_finds_a_planted_shift(spark):
    ratios = inference.log_ratios(cells_of(spark, shift=2.0))
    tested = inference.equivalence(inference.differences(inference.long_ratios(ratios)), ["overlap_pct", "nms_method", "coord"])
    got = {(r.nms_method, r.coord): r for r in tested.collect()}
    assert got["iou_grid_n1", "alr_Mac"].equivalent and not got["nn_dist_global", "alr_Mac"].equivalent
    assert got["nn_dist_global", "alr_Mac"].median == pytest.approx(0.69, abs=0.05)
    (v,) = inference.verdicts(tested).collect()
    assert not v.all_equivalent and v.reference_equivalent
    (v,) = inference.verdicts(tested, "nobody").collect()
    assert not v.reference_equivalent
    f = {r.coord: r for r in inference.friedman(inference.long_ratios(ratios, ["ilr_1", "ilr_2", "ilr_3"])).collect()}
    assert f["ilr_1"].p_value < 0.001 and f["ilr_1"].n_subjects == 12 and f["ilr_1"].p_holm >= f["ilr_1"].p_value
    pairs = inference.nemenyi(inference.long_ratios(ratios, ["ilr_1"]))
    p = {(r.method_a, r.method_b): r.p_value for r in pairs.collect()}
    assert len(p) == 6 and p["nn_dist_global", "none"] < 0.05 < p["iou_global", "iou_grid_n1"]


def test_friedman_by_hand(spark):
    values = {"a": [1.0, 2.0, 3.0, 1.0], "b": [2.0, 2.0, 1.0, 3.0], "c": [3.0, 5.0, 2.0, 4.0]}
    rows = [(f"s{k}", 0.0, m, "x", v) for m, x in values.items() for k, v in enumerate(x)]
    (r,) = inference.friedman(spark.createDataFrame(rows, "slide_id string, overlap_pct double, nms_method string, coord string, value double")).collect()
    # ranks: 1 2 3 | 1.5 1.5 3 | 3 1 2 | 1 2 3; sums 6.5 6.5 11; one tie of two
    even = 12 / (4 * 3 * 4) * (6.5**2 + 6.5**2 + 11**2) - 3 * 4 * 4
    assert r.statistic == pytest.approx(even / (1 - 6 / (4 * 24))) and r.kendall_w == pytest.approx(r.statistic / 8)


def test_outliers_find_a_planted_method(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(f"s{b % 4}", 0.0, 1, b, 0, f"m{m}", float(abs(r.normal()) + (10 if m == 2 else 0))) for b in range(60) for m in range(4)]
    dev = spark.createDataFrame(rows, "slide_id string, overlap_pct double, block_size long, block_x long, block_y long, nms_method string, mahalanobis_distance double")
    flags = {x.nms_method: x for x in outliers.permutation(outliers.tail_cells(dev)).collect()}
    assert flags["m2"].flagged_outlier and flags["m2"].frac_upper_tail == 1 and not flags["m0"].flagged_outlier
    share = {x.nms_method: x.frac_largest for x in outliers.largest_share(dev).collect()}
    assert share["m2"] == 1 and sum(share.values()) == pytest.approx(1)
    (sign,) = outliers.sign_test(outliers.tail_cells(dev), "m2").collect()
    assert sign.n_slides_above == sign.n_slides == 4 and sign.p_sign == 1 / 16


def test_all_methods_are_counted(spark):
    assert {r.nms_method for r in study(spark, SF).cells.select("nms_method").distinct().collect()} == set(METHODS)


def test_result_tables_are_compared_by_key(spark):
    nan = float("nan")
    left = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 3, None), ("d", 4, nan), ("e", 5, None), (None, 6, 1.0), ("g", 7, 0.0)], "k string, n long, v double")
    right = spark.createDataFrame([("a", 1, 1.05), ("b", 2, 1.2), ("c", 3, None), ("d", 4, nan), ("e", 5, 1.0), (None, 6, 1.0), ("h", 8, 0.0)], "k string, n long, v double")
    got = {(r.k, r.n): (r.status, r.gap_v) for r in validate.compare(left, right, ["k", "n"], {"v": 0.1}).collect()}
    assert {k: s for k, (s, _) in got.items()} == {("a", 1): "agrees", ("b", 2): "differs", ("c", 3): "agrees", ("d", 4): "agrees", ("e", 5): "differs", (None, 6): "agrees", ("g", 7): "only left", ("h", 8): "only right"}
    assert got["b", 2][1] == pytest.approx(0.2) and got["c", 3][1] is None


def test_boxes(spark):
    values = [1.0, 2.0, 2.5, 3.0, 4.0, 9.0, -7.0, None]
    (r,) = summary.boxes(spark.createDataFrame([("a", v) for v in values], "k string, v double"), "v", ["k"]).collect()
    assert (r.n, r.low, r.whisker_low, r.q25, r.median, r.q75, r.whisker_high, r.high, r.n_outside) == (7, -7.0, 1.0, 1.5, 2.5, 3.5, 4.0, 9.0, 2)
