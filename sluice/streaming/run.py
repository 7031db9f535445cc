"""Reading tables in files as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", pattern)
    return reader.parquet(path)
