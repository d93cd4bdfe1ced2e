"""Incremental ingest: new export files become conversations once, and the index is kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.normalize import normalize_exports


def ingest_exports(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """A stream from a folder of tables of export records to a table of conversations.

    Each micro-batch goes to its own folder, which a retry overwrites, so every record is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        normalize_exports(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
