import json
import math
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from jobs import common, corpus_composition, queries, suppression_report

ROOT, SF = Path(__file__).parent.parent.parent, "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"


def add(spark, folder, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def rows_of(df):
    plain_ = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(map(plain_, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def plain(rows, config):
    """{(source, lang): (n_docs, n_words, share, alr, gap, distance, outside)} by definition."""
    classes, at, strength = config["classes"], config["classes"].index(config["reference"]), config["strength"]
    docs, words, whole = Counter(), Counter(), Counter()
    for _, text, lang, source in rows:
        if lang in classes:
            n = len([w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
            docs[source, lang] += 1
            words[source, lang] += n
            whole[lang] += n

    def parts(counts):
        n, zeros = sum(counts), counts.count(0)
        if zeros * strength >= n:
            return [(c + strength) / (n + strength * len(counts)) for c in counts]
        return [strength / n if c == 0 else c / n * (1 - zeros * strength / n) for c in counts]

    out, unit = {}, 10 ** config["digits"]
    near = lambda x: math.floor(x * unit + 0.5) / unit
    every = parts([whole[c] for c in classes]) if sum(whole.values()) else None
    for source in {s for s, _ in docs}:
        counts = [words[source, c] for c in classes]
        if not sum(counts):
            continue
        p = parts(counts)
        clr = lambda v: [math.log(x) - sum(map(math.log, v)) / len(v) for x in v]
        distance = math.dist(clr(p), clr(every))
        for k, c in enumerate(classes):
            alr, gap = math.log(p[k] / p[at]), math.log(p[k] / p[at]) - math.log(every[k] / every[at])
            out[source, c] = (docs[source, c], counts[k], near(counts[k] / sum(counts)), near(alr), near(gap), near(distance), abs(near(gap)) > config["margin"])
    return out


def result(spark, output):
    return {(r.source, r.lang): (r.n_docs, r.n_words, r.share, r.alr, r.gap, r.distance, r.outside) for r in corpus_composition.read(spark, str(output)).collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key][:2] == row[:2] and got[key][6] == row[6] and got[key][2:6] == pytest.approx(row[2:6], abs=2e-6), key


def corpus(n, start=0):
    langs = ["en", "en", "en", "de", "fr", "es", "xx", None]
    return [(k, "word " * (k % 17) + ("\n" if k % 3 else "é"), langs[k % 8 if k % 5 else 0], f"s{k % 4}" if k % 11 else None) for k in range(start, start + n)]


def test_two_runs_over_growing_input_take_only_what_is_new(spark, tmp_path):
    folder, output, mark = tmp_path / "docs", str(tmp_path / "out"), str(tmp_path / "mark")
    config = common.config("corpus_composition") | {"files_per_batch": 1}
    first, second = corpus(90), corpus(130, 90)
    add(spark, folder, first)
    done = corpus_composition.run(spark, str(folder), output, mark, config)
    assert done["read"] == 90 and done["batches"] == 1
    close(result(spark, output), plain(first, config))
    add(spark, folder, second[:50])
    add(spark, folder, second[50:])
    done = corpus_composition.run(spark, str(folder), output, mark, config)
    assert done["read"] == 130 and done["batches"] == 2
    close(result(spark, output), plain(first + second, config))
    before = rows_of(corpus_composition.read(spark, output))
    assert corpus_composition.run(spark, str(folder), output, mark, config)["read"] == 0
    assert rows_of(corpus_composition.read(spark, output)) == before
    # all at once, elsewhere
    corpus_composition.run(spark, str(folder), f"{output}-2", f"{mark}-2")
    assert rows_of(corpus_composition.read(spark, f"{output}-2")) == before


def test_a_batch_that_was_written_and_not_committed_is_repeated(spark, tmp_path):
    folder, output, mark = tmp_path / "docs", str(tmp_path / "out"), tmp_path / "mark"
    for start in (0, 40):
        add(spark, folder, corpus(40, start))
        corpus_composition.run(spark, str(folder), output, str(mark))
    before = rows_of(corpus_composition.read(spark, output))
    for name in ("1", ".1.crc"):
        (mark / "commits" / name).unlink(missing_ok=True)
    assert corpus_composition.run(spark, str(folder), output, str(mark))["read"] == 40
    assert rows_of(corpus_composition.read(spark, output)) == before
    shutil.rmtree(mark)  # a new checkpoint starts anew and counts nothing twice
    assert corpus_composition.run(spark, str(folder), output, str(mark))["read"] == 80
    assert rows_of(corpus_composition.read(spark, output)) == before


def test_hard_documents(spark, tmp_path):
    folder, output = tmp_path / "docs", str(tmp_path / "out")
    config = common.config("corpus_composition")
    rows = [(1, None, "en", "a"), (2, "", "de", "a"), (3, " \t\r\n\x0b\x0c", "fr", "a"), (4, "w", None, "b"), (5, "one two", "en", None), (6, "x " * 200_000, "de", "c"), (7, "w", "zz", "d"), (8, "w\xa0w", "en", "e"), (8, "w\xa0w", "en", "e")]
    add(spark, folder, rows)
    corpus_composition.run(spark, str(folder), output, str(tmp_path / "mark"), config)
    got = result(spark, output)
    close(got, plain(rows, config))
    assert {s for s, _ in got} == {None, "c", "e"} and got["e", "en"][:2] == (2, 2)


def test_no_documents(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    done = corpus_composition.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert done == {"batches": 0, "read": 0, "written": 0}


def test_settings_of_the_users(tmp_path):
    own = tmp_path / "c.json"
    own.write_text(json.dumps({"margin": 0.5}))
    assert common.config("corpus_composition", str(own))["margin"] == 0.5
    own.write_text(json.dumps({"margins": 0.5}))
    with pytest.raises(ValueError, match="margins"):
        common.config("corpus_composition", str(own))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df, rel = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert rows_of(df) == sorted(rel.select(*columns).fetchall(), key=repr)


def detections(n, slide, overlap, start=0):
    labels = ["Makrophage", "Makrophage", "Lymphozyt", "NeutrophilerGranulozyt", "EosinophilerGranulozyt", "Artefakt"]
    out = []
    for k in range(n):
        x, y = (k * 37) % 600, (k * 91) % 600
        out.append((start + k, slide, overlap, labels[k % 6], 0.44 + (k % 50) / 100, x, y, x + 30, y + 30, x + 15.0, y + 15.0, 0, 0, 0, 0))
    return out


KIND = "det_id long, slide_id string, overlap_pct double, label string, confidence double, x1 long, y1 long, x2 long, y2 long, cx double, cy double, x_correct long, y_correct long, tile_x long, tile_y long"


def test_a_report_of_one_overlap_leaves_the_others(spark, tmp_path):
    folder, output = tmp_path / "dets", str(tmp_path / "out")
    config = common.config("suppression_report") | {"variants": ["iou_grid_n1", "nn_dist_grid_n1"]}
    add(spark, folder, detections(120, "a", 0.0) + detections(90, "b", 0.0, 500) + detections(60, "a", 0.25, 900), KIND)
    done = suppression_report.run(spark, str(folder), output, config)
    assert done["written"] == 15  # three slices and two overlaps; two variants and the reference
    before, other = (rows_of(suppression_report.read(spark, output).where(w)) for w in ("true", "overlap_pct = 0"))
    assert suppression_report.run(spark, str(folder), output, config) == done
    assert rows_of(suppression_report.read(spark, output)) == before
    add(spark, folder, detections(40, "c", 0.25, 2000) + detections(40, "c", 0.0, 3000), KIND)
    suppression_report.run(spark, str(folder), output, config | {"overlaps": [0.25]})
    now = suppression_report.read(spark, output)
    assert rows_of(now.where("overlap_pct = 0")) == other and len(other) == 9
    assert {r.slide_id for r in now.where("overlap_pct = 0.25").collect()} == {"a", "c", None} and {r.slide_id for r in now.where("overlap_pct = 0").collect()} == {"a", "b", None}


def test_report_by_hand(spark, tmp_path):
    far = [(1, "a", 0.0, "Makrophage", 0.9, 100, 100, 140, 140), (2, "a", 0.0, "Makrophage", 0.8, 101, 100, 141, 140), (3, "a", 0.0, "Lymphozyt", 0.7, 300, 300, 340, 340), (4, "a", 0.0, "Artefakt", 0.9, 500, 500, 540, 540),
           (5, "e", 0.0, "Lymphozyt", 0.9, 0, 0, 40, 40), (6, "low", 0.0, "Lymphozyt", 0.1, 100, 100, 140, 140)]
    add(spark, tmp_path / "d", [(*r, (r[5] + r[7]) / 2, (r[6] + r[8]) / 2, 0, 0, 0, 0) for r in far], KIND)
    config = common.config("suppression_report") | {"variants": ["iou_edgecrop_grid_n1"]}
    suppression_report.run(spark, str(tmp_path / "d"), str(tmp_path / "o"), config)
    got = {(r.slide_id, r.nms_method): r for r in suppression_report.read(spark, str(tmp_path / "o")).collect()}
    a, base = got["a", "iou_edgecrop_grid_n1"], got["a", "none"]
    assert (a.Mac, a.Lym, base.Mac, base.Lym) == (1, 1, 2, 1) and a.retained == pytest.approx(2 / 3, abs=1e-6) and a.pct_Mac == 50 and base.retained == 1
    assert a.alr_Mac == 0 and base.alr_Mac == pytest.approx(math.log(2), abs=1e-6) and a.diff_Mac == pytest.approx(-math.log(2), abs=1e-6) and a.within is False and base.within is True
    cropped = got["e", "iou_edgecrop_grid_n1"]  # nothing survives
    assert cropped.Lym == 0 and cropped.retained == 0 and cropped.alr_Mac is None and cropped.within is None
    low = got["low", "none"]
    assert low.Lym == 0 and low.retained is None
    study = got[None, "iou_edgecrop_grid_n1"]  # one slide has both log-ratios: no interval
    assert (study.Mac, study.Lym, study.retained) == (1, 1, 0.5) and math.isnan(study.diff_Mac) and study.within is False and got[None, "none"].within is None


def test_verdict_of_a_study(spark, tmp_path):
    rows = [r for k in range(6) for r in detections(120, f"s{k}", 0.0, 1000 * k)]
    add(spark, tmp_path / "d", rows, KIND)
    config = common.config("suppression_report") | {"variants": ["iou_grid_n1"], "margin": 5.0}
    suppression_report.run(spark, str(tmp_path / "d"), str(tmp_path / "o"), config)
    got = suppression_report.read(spark, str(tmp_path / "o")).where("nms_method = 'iou_grid_n1'").collect()
    (study,), slides = [r for r in got if r.slide_id is None], [r for r in got if r.slide_id]
    assert study.Mac == sum(r.Mac for r in slides) and len({r.diff_Mac for r in slides}) == 1  # slides alike
    assert study.diff_Mac == study.low_Mac == study.high_Mac == slides[0].diff_Mac and study.within is True and slides[0].low_Mac is None


def test_command_lines(tmp_path):
    own = tmp_path / "c.json"
    own.write_text(json.dumps({"variants": ["iou_grid_n1"]}))
    for args in (["jobs.corpus_composition", "--documents", f"{SF}/documents.parquet*"], ["jobs.suppression_report", "--detections", f"{SF}/lineitem.parquet", "--config", str(own)]):
        out = tmp_path / args[0]
        done = subprocess.run([sys.executable, "-m", *args, "--output", str(out)], cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read from" in done.stderr and "written to" in done.stderr
        assert list(out.rglob("*.parquet"))
