"""What the jobs share: configuration, rounding, their output read back, and the command line's session."""

from __future__ import annotations

import json
import logging
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config(name: str, path: str | None = None) -> dict:
    """The job's defaults, ``jobs/<name>.json``, with the values of a file of the user's in their place."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    own = json.loads(Path(path).read_text()) if path else {}
    if unknown := sorted(set(own) - set(found)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return found | own


def rounded(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    """The named reals, half up to so many digits; NaN stays."""
    unit = float(10**digits)
    return df.withColumns({c: F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * unit + 0.5) / unit) for c in names})


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that a job wrote; empty if it never did."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@contextmanager
def session(name: str):
    """The command line's session, with its logging."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        yield spark
    finally:
        spark.stop()
