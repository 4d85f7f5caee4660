"""The study of one data directory: detections, survivors and counts, each written once and read by many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import CONFIG, METHODS_25
from tessella.operators import agreement, consensus, counts, suppress
from tessella.operators.suppress import SWEEPS
from tessella.sources import fixture
from tessella.sources.scratch import cut

#: Fewer cells than the default, for the small fixture: tiles hold 166 to 324 rows at sf0.01.
MIN_CELLS = 100


class Study:
    """Tables by name, written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made = spark, sf_dir, {}

    def table(self, name: str, make) -> DataFrame:
        if name not in self.made:
            self.made[name] = cut(make(), f"study-{name}")
        return self.made[name]

    @property
    def detections(self) -> DataFrame:
        return self.table("detections", lambda: fixture.detections(self.spark, self.sf_dir))

    @property
    def confident(self) -> DataFrame:
        return self.detections.where(F.col("confidence") >= CONFIG.confidence)

    @property
    def masked(self) -> DataFrame:
        """Survivors of the 31 variants."""
        return self.table("masked", lambda: suppress.survivors(self.detections))

    @property
    def swept(self) -> DataFrame:
        return self.table("swept", lambda: suppress.survivors(self.detections, SWEEPS))

    def settings(self, prefix: str) -> DataFrame:
        """Survivors of the sweeps' settings whose names begin so, and of no others."""
        some = {n: v for n, v in SWEEPS.items() if n.startswith(prefix)}
        return self.table(f"swept-{prefix}", lambda: suppress.survivors(self.detections, some))

    @property
    def cells(self) -> DataFrame:
        return self.table("cells", lambda: counts.cells(self.masked))

    @property
    def tiles(self) -> DataFrame:
        return self.table("tiles", lambda: counts.tiles(self.masked))

    @property
    def blocks(self) -> DataFrame:
        return self.table("blocks", lambda: counts.blocks(self.tiles))

    @property
    def eligible(self) -> DataFrame:
        return self.table("eligible", lambda: counts.masked_blocks(self.blocks, MIN_CELLS))

    @property
    def deviations(self) -> DataFrame:
        """Consensus and deviations of the 25 variants without edge cropping."""
        return self.table("deviations", lambda: consensus.deviations(agreement.coordinates(self.eligible.where(F.col("nms_method").isin(*METHODS_25)))))


_STUDIES: dict[tuple[str, str], tuple[tuple, Study]] = {}


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(place)
    found = fs.listStatus(place) if status.isDirectory() else [status]
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found))


def study(spark: SparkSession, sf_dir: str) -> Study:
    """The study of a directory as it is now: its tables are made anew once the input's files change."""
    key = spark.sparkContext.applicationId, sf_dir
    version = _files(spark, f"{sf_dir}/lineitem.parquet")
    if key not in _STUDIES or _STUDIES[key][0] != version:
        _STUDIES[key] = version, Study(spark, sf_dir)
    return _STUDIES[key][1]
