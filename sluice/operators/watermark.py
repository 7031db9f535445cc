"""Watermarks over a bounded replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Arrivals in a run of the two-level running maximum.
RUN = 100_000
LATENESS = 1000


def with_watermark(df: DataFrame, lateness: int = LATENESS, run: int = RUN) -> DataFrame:
    """``_wm``: the largest event time among earlier arrivals (``_seq``) less ``lateness``; null for the first.

    The running maximum is taken within runs of arrivals and over the runs' maxima, so
    no task sorts all rows."""
    runs = df.groupBy(F.floor(F.col("_seq") / run).alias("_run")).agg(F.max("_ts").alias("_m"))
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_run").alias("_r"), F.max("_m").over(earlier).alias("_m"))
    before = Window.partitionBy("_run").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("_run", F.floor(F.col("_seq") / run)).withColumn("_own", F.max("_ts").over(before))
    joined = own.join(runs, F.col("_run") == F.col("_r"), "left")
    return joined.withColumn("_wm", F.greatest("_own", "_m") - lateness).drop("_run", "_own", "_r", "_m")


def drop_late(df: DataFrame, lateness: int = LATENESS) -> DataFrame:
    return with_watermark(df, lateness).filter(F.coalesce(F.col("_ts") >= F.col("_wm"), F.lit(True))).drop("_wm")


def drop_late_together(sources: dict[str, DataFrame], lateness: int = LATENESS) -> dict[str, DataFrame]:
    """The rows of each source that aren't late by one watermark over all of them: the largest event time
    among earlier arrivals (``_seq``) of any source, less ``lateness``."""
    if len(sources) == 1:
        return {name: drop_late(df, lateness) for name, df in sources.items()}
    arrivals = None
    for df in sources.values():
        own = df.select("_seq", "_ts")
        arrivals = own if arrivals is None else arrivals.unionByName(own)
    marks = with_watermark(arrivals.groupBy("_seq").agg(F.max("_ts").alias("_ts")), lateness).select(F.col("_seq").alias("_at"), "_wm")
    out = {}
    for name, df in sources.items():
        seen = df.join(marks, F.col("_seq") == F.col("_at"), "left")
        out[name] = seen.filter(F.coalesce(F.col("_ts") >= F.col("_wm"), F.lit(True))).select(*df.columns)
    return out
