"""Tables written to the shared scratch folder, to end lineage and to be read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process wrote and has not deleted, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only in local mode, where driver and executor are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tessella-scratch"
    return root.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to scratch and return it reread: Spark then knows its size."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    _WRITTEN[path] = spark
    return back


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote; nothing may read them afterwards."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


def clear() -> None:
    """Delete all tables that ``cut`` wrote, for when no result is read any more."""
    for path, spark in list(_WRITTEN.items()):
        _delete(spark, path)
