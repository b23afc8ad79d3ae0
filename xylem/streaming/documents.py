"""Documents that arrive as files, validated batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import validate
from ..plans.schema import SchemaSet


def read_stream(spark: SparkSession, path: str, glob: str = "*.xml", per_batch: int = 1000) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path).select(F.col("path").alias("uri"), F.col("modificationTime").alias("arrived"), F.col("content").alias("xml"))


def validated(docs: DataFrame, schemas: SchemaSet) -> DataFrame:
    """A stream of reports; each document is judged alone, so no state is kept."""
    return validate(docs, schemas)


def counted(reports: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Valid and invalid documents by time of arrival."""
    return reports.withWatermark("arrived", late).groupBy(F.window("arrived", every), "valid").count()


def write(reports: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    out = reports.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
