"""Loading of detector output: one CSV file for each slide and overlap, in ``<percent>_overlap_raw/<slide>.csv``.

A file is one row of bytes, parsed and checked by one task; a file that fails a check is reported and not loaded. Only
files whose (slide, overlap) the store lacks are read.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import schemas
from tessella.config import CONFIG, Config
from tessella.sources.store import Store


def folder_name(overlap: float) -> str:
    """0.05 is in ``5_overlap_raw``, 0.025 in ``2.5_overlap_raw``."""
    return f"{round(overlap * 100, 6):g}_overlap_raw"


def parse(data: bytes, overlap: float, width: float | None, height: float | None, config: Config = CONFIG) -> pd.DataFrame:
    """Checked detections of one file, in the image's coordinates; raises ValueError with the reason."""
    df = pd.read_csv(io.BytesIO(data), float_precision="round_trip")
    missing = [f.name for f in schemas.CSV if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = df[df["label"].isin(config.labels)].reset_index(drop=True)
    boxes = ["x1", "y1", "x2", "y2"]
    if df.empty:
        return df.assign(cx=0.0, cy=0.0, tile_x=0, tile_y=0)
    numbers = ["confidence", *boxes, "x_correct", "y_correct"]
    df[numbers] = df[numbers].apply(pd.to_numeric)  # a text among numbers is a ValueError
    if df[boxes].isna().any(axis=None) or (df[boxes] % 1 != 0).any(axis=None):
        raise ValueError("box coordinates are not whole numbers")
    if df[boxes].max(axis=None) > 1.5 * config.tile:
        raise ValueError("coordinates are already absolute")
    step = config.stride(overlap)
    for a in "xy":
        at = df[f"{a}_correct"]
        if (at < 0).any():
            raise ValueError("negative tile origins")
        if (at % step == 0).mean() < config.grid_tolerance:
            raise ValueError(f"tile origins are off the grid of {step} pixels")
        df[f"{a}1"], df[f"{a}2"] = df[f"{a}1"] + at, df[f"{a}2"] + at
        df[f"c{a}"], df[f"tile_{a}"] = (df[f"{a}1"] + df[f"{a}2"]) / 2.0, at // step
    if width is not None and (df["x2"].max() > width + config.tile or df["y2"].max() > height + config.tile):
        raise ValueError("boxes outside the image")
    return df


def files(spark: SparkSession, data_dir: str, config: Config = CONFIG) -> DataFrame:
    """(path, slide_id, overlap_pct) of the CSV files of known overlaps; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(data_dir)
    return located(found.select("path"), config)


def located(found: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Adds slide and overlap to files, which may come with or without their content."""
    place = F.regexp_extract("path", r"/([0-9.]+_overlap_raw)/([^/]+)\.csv$", 1)
    overlap = F.coalesce(*(F.when(place == folder_name(o), F.lit(float(o))) for o in config.overlaps))
    slide = F.regexp_extract("path", r"/([0-9.]+_overlap_raw)/([^/]+)\.csv$", 2)
    return found.select("path", *(c for c in found.columns if c == "content"), slide.alias("slide_id"), overlap.alias("overlap_pct")).where("overlap_pct is not null")


def typed(df: pd.DataFrame) -> pd.DataFrame:
    """All columns of a result, each in its type; those that a failed file lacks are null."""
    df = df.reindex(columns=[*schemas.DETECTIONS.names, "error"])
    kinds = {f.name: f.dataType.simpleString() for f in schemas.DETECTIONS}
    for name in df.columns:
        kind = kinds.get(name, "string")
        df[name] = df[name].astype({"bigint": "Int64", "double": float}[kind]) if kind != "string" else df[name].astype(object).where(df[name].notna(), None)
    return df


OUT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.DETECTIONS) + ", error string"


def read(jobs: DataFrame, slides: DataFrame, config: Config = CONFIG, first: int = 0) -> DataFrame:
    """Detections of the files, and a row with ``error`` for each that fails, whatever its fault.

    det_id ascends by file, then row; files are numbered from ``first``. Files (a row each) are joined to what is known of
    them by name; contents are read last and are never shuffled.
    """
    spark = jobs.sparkSession
    known = slides.select("slide_id", F.col("image_w").cast("double"), F.col("image_h").cast("double"))
    number = F.dense_rank().over(Window.orderBy("overlap_pct", "slide_id")) - 1 + first  # a row a file
    named = jobs.select("path", "slide_id", "overlap_pct").withColumn("number", number.cast("long")).join(known, "slide_id", "left")
    about = {r.path: r for r in named.collect()}
    if "content" in jobs.columns:
        rows = jobs.select("path", "content")
    elif about:
        rows = spark.read.format("binaryFile").load(list(about)).select("path", "content")
    else:
        rows = spark.createDataFrame([], "path string, content binary")

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                f = about[path]
                try:
                    df = parse(bytes(content), f.overlap_pct, f.image_w, f.image_h, config)
                    df = df.assign(det_id=(f.number << 32) + df.index, slide_id=f.slide_id, overlap_pct=f.overlap_pct, error=None)
                    df = typed(df)
                except Exception as e:  # a fault of one file is reported and stops no other
                    df = typed(pd.DataFrame([{"slide_id": f.slide_id, "overlap_pct": f.overlap_pct, "error": f"{type(e).__name__}: {e}"}]))
                yield df

    return rows.mapInPandas(run, OUT)


def load(store: Store, slides: DataFrame, jobs: DataFrame, config: Config = CONFIG) -> dict:
    """Load the files that the store lacks: {rows, loaded, skipped, missing, failed, errors}.

    ``missing`` counts slides and overlaps that have no file. Files are numbered on from the largest number that the store
    holds, so no det_id is given twice; one load or stream writes to a store at a time.
    """
    from tessella.sources.scratch import cut, discard

    stored = store.read("raw_detections")
    have = stored.select("slide_id", "overlap_pct").distinct()
    jobs = jobs.join(F.broadcast(slides.select("slide_id")), "slide_id", "left_semi")
    names = jobs.select("path", "slide_id", "overlap_pct")
    total = names.count()
    missing = slides.count() * len(config.overlaps) - names.select("slide_id", "overlap_pct").distinct().count()
    new = names.join(have, ["slide_id", "overlap_pct"], "left_anti")
    if "content" in jobs.columns:
        new = jobs.select("path", "content").join(F.broadcast(new), "path")  # a row a file; contents stay where they are
    fresh = new.select("path").count()
    if not fresh:
        return {"rows": 0, "loaded": 0, "skipped": total, "missing": missing, "failed": 0, "errors": {}}
    largest = stored.agg(F.max("det_id")).first()[0]
    done = cut(read(new, slides, config, 0 if largest is None else (largest >> 32) + 1), "load")
    errors = {(r.slide_id, r.overlap_pct): r.error for r in done.where("error is not null").select("slide_id", "overlap_pct", "error").collect()}  # a row a file
    good = done.where("error is null and det_id is not null").drop("error")
    store.write("raw_detections", good)
    store.write("slides", slides)
    rows = good.count()
    discard(done)
    return {"rows": rows, "loaded": fresh - len(errors), "skipped": total - fresh, "missing": missing, "failed": len(errors), "errors": errors}
