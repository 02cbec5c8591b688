"""Verdicts for documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillon.operators import rubric, tells


def read(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """New Parquet files under path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tell_rates(docs: DataFrame) -> DataFrame:
    """Rates of all tells for each document of a stream or table."""
    return tells.rates(docs)


def slop(docs: DataFrame, norm: DataFrame | None, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's verdicts under out; a batch that is run again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        rubric.result(batch, tells.findings(batch, norm), rubric.SLOP).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
