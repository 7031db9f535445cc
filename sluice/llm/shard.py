"""Shards by a two-pass external shuffle.

Pass one scatters whole records into buckets of about ``bucket_bytes`` by a
seeded hash of id, text and, for a table read from files, the row's place in it, so rows that
repeat both scatter as well.  Pass two permutes the buckets (``shuffle`` is Spark's inside-out
Fisher-Yates) and writes them; a task gets some of them, about ``TASK_BYTES``, and holds no more.  Buckets in
order, each permuted, form one random order of all records; the shards are
consecutive runs of it whose row counts are at most one apart (law ``rows``), so
a bucket is written to one or two shards only.  The buckets' places are prefix sums in two
levels: within groups of about the square root of their number, and over the groups.

Defined results: a null text has size 1 (no bytes); nulls are hashed like a value of their own; copies
of a text scatter as all rows do; rows that repeat id and text of a table that isn't read from files
share a bucket unless ``place`` tells them apart; other columns may be of any kind; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_path, shuffle_partitions, table

#: Bytes of text that a bucket holds, on average, and those of a task.
BUCKET_BYTES = 8 << 20
TASK_BYTES = 64 << 20
SEED = 20240229


def row_place(docs: DataFrame) -> list[Column]:
    """What tells the rows of a table in files apart; nothing for other frames."""
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*place).schema
    except AnalysisException:
        return []
    return place


def scattered(docs: DataFrame, buckets: int, place: list[Column], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``bucket, h, record``."""
    hashed = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col], *place)
    return docs.select(F.pmod(hashed, F.lit(buckets)).alias("bucket"), hashed.alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("record"))


def bucket_offsets(counts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, offset`` from ``bucket, n``: how many rows stand in the buckets before."""
    width = max(1, round(buckets**0.5))
    grouped = counts.withColumn("part", F.floor(F.col("bucket") / width))
    running = lambda spec: F.coalesce(F.sum("n").over(spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = grouped.groupBy("part").agg(F.sum("n").alias("n")).select("part", running(Window.orderBy("part")).alias("earlier"))
    within = grouped.withColumn("own", running(Window.partitionBy("part").orderBy("bucket")))
    return within.join(parts, "part").select("bucket", (F.col("earlier") + F.col("own")).alias("offset"))


def scatter_shuffle(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
    place: list[Column] | None = None,
) -> DataFrame:
    """``shard, slot, record``: the whole rows of ``docs`` in their new places."""
    size = F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 1
    total = docs.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    rows, size_all = total["n"], total["b"] or 0
    tasks = max(-(-size_all // TASK_BYTES), shuffle_partitions(docs.sparkSession))
    buckets = max(-(-size_all // bucket_bytes), 2 * tasks)
    placed = scattered(docs, buckets, row_place(docs) if place is None else place, id_col, text_col, seed)
    offsets = bucket_offsets(cut(placed.groupBy("bucket").agg(F.count("*").alias("n"))), buckets)
    # The order before shuffling is that of the hashes, whatever order records arrive in.
    order = F.transform(F.array_sort(F.transform("records", lambda r, i: F.struct(r["h"].alias("h"), i.alias("i")))), lambda x: x["i"])
    permuted = (
        placed.repartition(tasks, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("h", "record")).alias("records"))
        .select("bucket", F.transform(F.shuffle(order, seed), lambda i: F.get(F.col("records"), i)["record"]).alias("records"))
        .join(offsets.hint("shuffle_hash"), "bucket")
        .select("offset", F.posexplode("records").alias("pos", "record"))
        .select((F.col("offset") + F.col("pos")).alias("place"), "record")
    )
    base, more = divmod(rows, shards)
    edge = more * (base + 1)
    place = F.col("place")
    in_large, in_small = F.floor(place / (base + 1)), F.lit(more) + F.floor((place - edge) / max(base, 1))
    shard = F.when(place < edge, in_large).otherwise(in_small).cast("int")
    first = F.when(F.col("shard") < more, F.col("shard") * (base + 1)).otherwise(edge + (F.col("shard") - more) * base)
    return permuted.withColumn("shard", shard).select("shard", (F.col("place") - first).cast("long").alias("slot"), "record")


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> DataFrame:
    """Writes the shards as folders ``shard=N`` of Parquet files and returns what they hold."""
    scatter_shuffle(docs, shards, **options).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(shard_schema(docs)).parquet(path)


def shard_schema(docs: DataFrame):
    return T.StructType([T.StructField("slot", T.LongType()), T.StructField("record", docs.schema), T.StructField("shard", T.IntegerType())])


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shards(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"), 8)
    text = F.col("record.text")
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
