"""Incremental ingest with Structured Streaming: new CSV files are loaded, suppressed and counted as they arrive.

An addition to the batch jobs. Progress is kept in the stream's checkpoint and in the store's manifest; a batch that is
repeated replaces its own partitions, so each file counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.config import CONFIG, Config
from tessella.plans import jobs
from tessella.sources import images, load
from tessella.sources.store import Store

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def follow(store: Store, images_dir: str, data_dir: str, checkpoint: str, available_now: bool = True, config: Config = CONFIG) -> StreamingQuery:
    """Start the stream; with ``available_now`` it ends when the files that are there now are done."""
    spark = store.spark
    store.init()
    arriving = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(data_dir)

    def take(batch: DataFrame, _: int) -> None:
        load.load(store, images.slides(spark, images_dir, config), load.located(batch, config), config)
        jobs.run(store, config=config)

    writer = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
