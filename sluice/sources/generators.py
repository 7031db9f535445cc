"""Synthetic sources: seeded, reproducible for a seed and independent of partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = ("ALPH", "BRVO", "CHRL", "DLTA", "ECHO", "FOXT")
VENUES = ("XNAS", "XNYS", "BATS", "ARCX")
CANCELED = 0.15


def uniform(seed: int, what: str) -> Column:
    """A number in [0, 1) that depends on the row's id, the seed and a label only."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(1 << 53)) / float(1 << 53)


def pick(values: tuple, seed: int, what: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(uniform(seed, what) * len(values)) + 1).cast("int"))


def _rows(spark: SparkSession, n: int, per_second: float, start: int) -> DataFrame:
    return spark.range(n).withColumn("_ts", (F.lit(start) + F.floor(F.col("id") * (1000.0 / per_second))).cast("bigint")).withColumn("_seq", F.col("id"))


def trades(spark: SparkSession, n: int, seed: int = 1, per_second: float = 8.0, start: int = 0) -> DataFrame:
    return _rows(spark, n, per_second, start).select(
        pick(SYMBOLS, seed, "symbol").alias("symbol"), F.round(50 + 200 * uniform(seed, "price"), 2).alias("price"),
        (F.floor(uniform(seed, "qty") * 500) + 1).cast("bigint").alias("qty"), pick(("BUY", "SELL"), seed, "side").alias("side"),
        pick(VENUES, seed, "venue").alias("venue"), "_ts", "_seq",
    )


def quotes(spark: SparkSession, n: int, seed: int = 1, per_second: float = 10.0, start: int = 0) -> DataFrame:
    mid, half = 50 + 200 * uniform(seed, "mid"), 0.01 + 0.05 * uniform(seed, "half")
    size = lambda w: (F.floor(uniform(seed, w) * 900) + 100).cast("bigint")
    return _rows(spark, n, per_second, start).select(
        pick(SYMBOLS, seed, "symbol").alias("symbol"), F.round(mid - half, 2).alias("bid"), F.round(mid + half, 2).alias("ask"),
        size("bid").alias("bidSize"), size("ask").alias("askSize"), pick(VENUES, seed, "venue").alias("venue"), "_ts", "_seq",
    )


def stages(rng: np.random.Generator) -> list[str]:
    """NEW, ACK, up to three partial fills, then filled or, at times, canceled."""
    end = "CANCELED" if rng.random() < CANCELED else "FILLED"
    return ["NEW", "ACK", *["PART_FILL"] * int(rng.integers(0, 4)), end]


def lifecycle(spark: SparkSession, orders: int, seed: int = 1, start: int = 0) -> DataFrame:
    """The events of ``orders`` orders, each from its own seeded generator."""

    def run(frames):
        for frame in frames:
            rows = []
            for k in frame["id"].tolist():
                rng = np.random.default_rng([seed, k])
                symbol, side, qty = SYMBOLS[rng.integers(len(SYMBOLS))], ("BUY", "SELL")[rng.integers(2)], int(rng.integers(1, 50)) * 100
                steps, filled = stages(rng), 0
                for rank, stage in enumerate(steps):
                    if stage == "PART_FILL":
                        filled += int((qty - filled) * rng.uniform(0.1, 0.5))
                    elif stage == "FILLED":
                        filled = qty
                    rows.append((f"O{k}", symbol, side, stage, rank, qty, filled, start + k * 500 + rank * 200))
            yield pd.DataFrame(rows, columns=["order_id", "symbol", "side", "stage", "stage_rank", "qty", "filled_qty", "_ts"])

    return spark.range(orders).mapInPandas(run, "order_id string, symbol string, side string, stage string, stage_rank long, qty long, filled_qty long, _ts long")


def scenarios(
    spark: SparkSession, run_id: str, paths: int, instruments: list[str], days: int, seed: int = 1, rho: float = 0.3, kind: str = "normal",
    volatility: float = 0.01, freedom: float = 5.0, max_rows: int | None = None,
) -> DataFrame:
    """Monte-Carlo days of correlated instruments: shock = sqrt(rho) factor + sqrt(1 - rho) own.

    Each path has its own seeded generator, drawn day by day, so paths are computed anywhere."""
    if kind not in ("normal", "lognormal", "student_t"):
        raise ValueError(f"unknown distribution {kind}")
    if kind == "student_t" and freedom <= 2:
        raise ValueError("a variance needs more than 2 degrees of freedom")
    if not 0 <= rho <= 1:
        raise ValueError("rho lies between 0 and 1")
    if max_rows is not None and paths * len(instruments) * days > max_rows:
        raise ValueError("the run has more rows than allowed")
    k = len(instruments)

    def run(frames):
        for frame in frames:
            for path in frame["id"].tolist():
                rng = np.random.default_rng([seed, path])
                # Student's t is scaled to variance 1.
                scale = np.sqrt(freedom / (freedom - 2))
                draw = (lambda n: rng.standard_t(freedom, n) / scale) if kind == "student_t" else rng.standard_normal
                factor, shock = np.empty(days), np.empty((days, k))
                for d in range(days):
                    factor[d] = draw(1)[0]
                    shock[d] = np.sqrt(rho) * factor[d] + np.sqrt(1 - rho) * draw(k)
                value = np.exp(volatility * shock - 0.5 * volatility**2) if kind == "lognormal" else volatility * shock
                yield pd.DataFrame({"run_id": run_id, "path_id": path, "instrument_id": np.tile(instruments, days), "day": np.repeat(np.arange(days), k), "factor": np.repeat(factor, k), "shock": shock.ravel(), "value": value.ravel()})

    return spark.range(paths).mapInPandas(run, "run_id string, path_id long, instrument_id string, day long, factor double, shock double, value double")
