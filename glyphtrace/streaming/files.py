"""The same scan over files as they arrive. Detectors are narrow, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..sources.files import SCHEMA


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").load(path)


def scan_stream(spark: SparkSession, path: str, sink: str, checkpoint: str, config: Config = DEFAULT) -> StreamingQuery:
    """Scan what has arrived since the checkpoint and append findings to ``sink`` as Parquet."""
    from ..plans.scan import scan_files

    def write(batch: DataFrame, epoch: int) -> None:
        scan_files(batch, config).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")  # the same epoch again overwrites itself

    return stream_files(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
