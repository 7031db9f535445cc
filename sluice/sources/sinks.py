"""Sinks: append files, upserts by key, and the guard against feedback loops."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sink(Protocol):
    def write(self, rows: DataFrame) -> DataFrame:
        """Writes the rows and gives what was written of them."""


@dataclass
class FileSink:
    """Appends to a folder of files.  ``{name}`` in the path is filled in.  ``columns`` fix the header: rows are
    written with just these, missing ones as null, and ``dropped`` counts the columns left out so far."""

    path: str
    kind: str = "json"
    columns: list[str] | None = None
    name: str = ""
    dropped: int = 0

    def write(self, rows: DataFrame) -> DataFrame:
        if self.columns is not None:
            self.dropped += len([c for c in rows.columns if c not in self.columns])
            rows = rows.select(*[F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in self.columns])
        at = f"{self.path.replace('{name}', self.name)}/batch-{uuid.uuid4().hex}"
        if self.kind == "parquet":
            rows.write.parquet(at)
            return rows.sparkSession.read.schema(rows.schema).parquet(at)
        append_file(rows, at, self.kind)
        read = rows.sparkSession.read.schema(rows.schema)
        return read.option("header", True).csv(at) if self.kind == "csv" else read.json(at)


@dataclass
class CallSink:
    """Hands rows to a function of a frame: a database (``jdbc.append``, ``jdbc.upsert``), a service (``http.post``)."""

    send: Callable[[DataFrame], object]

    def write(self, rows: DataFrame) -> DataFrame:
        self.send(rows)
        return rows


@dataclass
class LoopbackSink:
    """Feeds a relation of an engine: rows come back as arrivals of ``name``, guarded against going round forever."""

    engine: object
    name: str
    path: str
    depth: int = 8
    written: list[str] = field(default_factory=list)

    def write(self, rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        at = f"{self.path}/{self.name}-{uuid.uuid4().hex}"
        step_guard(rows, self.depth).write.parquet(at)
        self.written.append(at)
        out = spark.read.parquet(at)
        self.engine.register(self.name, spark.read.option("mergeSchema", True).parquet(*self.written))
        return out


def append_file(df: DataFrame, path: str, kind: str = "json") -> None:
    """Appends CSV (with a header per file) or one JSON value per line."""
    writer = df.write.mode("append")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def write_sharded(df: DataFrame, path: str, by: list[str], shards: int) -> None:
    """Files in folders ``_shard=N``: all rows of a key stand in one shard."""
    owner = F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int")
    df.withColumn("_shard", owner).write.partitionBy("_shard").mode("overwrite").parquet(path)


def read_shard(spark, path: str, key: dict, shards: int) -> DataFrame:
    """The rows of one key; reads its shard only.  ``key`` maps columns to values of the columns' own types."""
    rows = spark.read.parquet(path)
    typed = [F.lit(v).cast(rows.schema[c].dataType) for c, v in key.items()]
    out = rows.filter(F.col("_shard") == F.pmod(F.xxhash64(*typed), F.lit(shards)).cast("int"))
    for (c, _), v in zip(key.items(), typed):
        out = out.filter(F.col(c).eqNullSafe(v))
    return out.drop("_shard")


def upsert_plan(deltas: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to write and keys to delete: per key the last delta of the batch counts; null keys are skipped.

    Writes go first, deletes last."""
    known = deltas.dropna(subset=keys)
    row = F.struct(*known.columns)
    last = known.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.max_by(row, F.col("_seq")).alias("r")).select("r.*")
    return last.filter("_weight > 0").drop("_weight", "_seq"), last.filter("_weight <= 0").select(*keys)


def merge_into(spark, current: DataFrame | None, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert batch."""
    writes, deletes = upsert_plan(deltas, keys)
    if current is None:
        return writes
    touched = writes.select(*keys).unionByName(deletes)
    return current.join(touched, keys, "left_anti").unionByName(writes.select(*current.columns))


def step_guard(df: DataFrame, depth: int, field: str = "_step") -> DataFrame:
    """Rows that have gone round less than ``depth`` times, one step on."""
    step = F.coalesce(F.col(field).cast("bigint"), F.lit(0)) if field in df.columns else F.lit(0).cast("bigint")
    return df.withColumn(field, step).filter(F.col(field) < depth).withColumn(field, F.col(field) + 1)
