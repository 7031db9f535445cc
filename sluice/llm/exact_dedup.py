"""Exact duplicates by a heavy-hitter split.

Every text is reduced to its SHA-256.  A Misra-Gries summary (the frequent-items
sketch behind ``approx_top_k``, which merges across partitions) names the digests
that may be frequent; their exact counts and winners are then verified in a second
pass.  The verified winners, at most ``HEAVY`` rows whatever the input, are broadcast:
rows with such a digest are decided on the map side and never shuffled.  All
other digests go through an ordinary shuffle, in groups that the summary bounds
to about 1/``HEAVY`` of the rows.

Defined results: a null text counts as empty; the row with the largest id of a
group stays (null ids are smaller than any); of rows that repeat both id and text
exactly one stays; an empty table gives an empty table; other columns take no part
and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Digests that are decided on the map side, at most.
HEAVY = 1024
#: Counters of the Misra-Gries summary.
TRACKED = 16384


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def frequent(keys: DataFrame, column: str, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """Candidates for the most frequent values of ``column``: at most ``heavy`` rows."""
    top = keys.select(F.expr(f"approx_top_k(`{column}`, {heavy}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(column))


def verified_winners(keys: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """``digest, keep_id, keep_row, group_size, ties`` of frequent digests, exact.

    ``keys`` has ``digest, id, row``.  ``ties`` counts the rows with the largest id."""
    found = F.broadcast(frequent(keys, "digest", heavy, tracked))
    per_id = (
        keys.join(found, "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("best"))
        .filter("group_size > 1")
        .select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    )
    return cut(per_id)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, digest``."""
    keys = cut(
        docs.select(
            F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")
        )
    )
    winners = verified_winners(keys, heavy, tracked)
    out = ("id", "keep_id", "group_size", "kept", "digest")
    hot = keys.join(F.broadcast(winners), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    group = Window.partitionBy("digest")
    ranked = group.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    rest = (
        keys.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("kept", F.row_number().over(ranked) == 1)
        .withColumn("keep_id", F.max("id").over(group))
        .withColumn("group_size", F.count("*").over(group))
    )
    return hot.select(*out).unionByName(rest.select(*out))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, tracked: int = TRACKED
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows of frequent digests lose on the map side; only rows that repeat the
    winner's id as well are merged further, by an aggregate that combines on the
    map side.  The rest is shuffled by digest once."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r")).withColumn(
        "digest", digest_of(F.col("r").getField(text_col))
    )
    keys = cut(row.select(F.col("r").getField(id_col).alias("id"), "digest", F.lit(0).alias("row")))
    winners = verified_winners(keys, heavy, tracked).select("digest", "keep_id")
    hot = (
        row.join(F.broadcast(winners), "digest")
        .filter(F.col("r").getField(id_col).eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.first("r").alias("r"))
    )
    ranked = Window.partitionBy("digest").orderBy(F.col("r").getField(id_col).desc_nulls_last())
    rest = (
        row.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("n", F.row_number().over(ranked))
        .filter("n = 1")
    )
    return hot.select("r.*").unionByName(rest.select("r.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
