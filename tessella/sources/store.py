"""The study's tables as partitioned Parquet under one root. Writing is an upsert by key, so a run can be repeated or added to.

Partitions are replaced when a write is committed (dynamic overwrite): one that is cut short before leaves the table as it
was. Large tables are partitioned by all of their key, so a write touches nothing else. In small ones, whose partitions
hold several keys, the other rows of a touched partition are read and written again with the new ones, through scratch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import schemas
from tessella.sources.scratch import cut, discard

UNIT, METHOD = ["overlap_pct", "slide_id"], ["overlap_pct", "slide_id", "nms_method"]
PARTITIONS = {
    "raw_detections": UNIT, "cell_counts": UNIT, "tile_counts": METHOD, "block_counts": METHOD, "block_consensus": UNIT, "method_deviation": UNIT,
    "checkpoint": UNIT, "timing": ["overlap_pct"], "slides": ["slot"],
}
#: Keys of the tables whose partitions hold more than one; a partition of another table is replaced as a whole.
KEYS = {"cell_counts": METHOD, "checkpoint": METHOD, "timing": METHOD, "slides": ["slide_id"]}
SLOTS = 16


class Store:
    """Tables of a study; a table that was never written reads as empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        schema = schemas.TABLES[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name)).select(*schema.names)

    def write(self, name: str, df: DataFrame) -> None:
        """Put the rows of ``df`` in the place of those with the same keys; all others stay."""
        parts, keys = PARTITIONS[name], KEYS.get(name)
        df = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]))
        place = lambda rows: rows.withColumn("slot", F.pmod(F.xxhash64("slide_id"), F.lit(SLOTS)).cast("int")) if parts == ["slot"] else rows
        if not keys:
            return self._replace(name, place(df))
        new = cut(place(df), f"store-{name}")
        near = place(self.read(name)).join(new.select(*parts).distinct(), parts, "left_semi")
        merged = cut(near.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new), f"store-{name}")
        self._replace(name, merged)
        discard(new, merged)

    def _replace(self, name: str, df: DataFrame) -> None:
        """Replace the partitions that ``df`` has."""
        parts = PARTITIONS[name]
        spread = [p for p in parts if p != "nms_method"]  # a task writes all methods of a slide and overlap
        writer = df.repartition(*spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*parts).parquet(self.path(name))

    def init(self) -> None:
        """Create the tables that are missing, empty."""
        for name, schema in schemas.TABLES.items():
            if not self.exists(name):
                self.write(name, self.spark.createDataFrame([], schema))

    def status(self) -> dict[str, int | None]:
        """Rows of each table; None where it is missing."""
        return {name: self.read(name).count() if self.exists(name) else None for name in schemas.TABLES}
