"""What the training-data operators share: tables in a run's input folder and
storage that every executor sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import fresh_path, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once, without its lineage: for narrow tables that are
    read more than once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame, rows: int, per_file: int = 1 << 16) -> DataFrame:
    """As ``cut``, in files by the number of rows (about ``rows``), not of shuffle partitions.

    Hadoop's local file system starts a ``chmod`` for each file and its checksum, and the child shares the
    executor's memory until it has started."""
    return cut(df.repartition(1 + rows // per_file))


def staged(df: DataFrame, what: str) -> DataFrame:
    """As ``cut``, but as compressed Parquet in the shared folder: for wide tables."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["cut", "fresh_path", "gathered", "shared_dir", "shuffle_partitions", "staged", "table"]
