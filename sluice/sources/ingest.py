"""Admission of pushed rows: what a bounded buffer does with a batch, and what a row becomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import coerce

CAPACITY = 10_000
BATCH = 1_000
POLICIES = ("reject", "block", "drop_newest", "drop_oldest", "inline")


@dataclass(frozen=True)
class Decision:
    accept: int
    evict: int = 0
    dropped: int = 0
    rejected: bool = False
    wait: bool = False


def decide(policy: str, held: int, arriving: int, capacity: int = CAPACITY) -> Decision:
    """How many of ``arriving`` rows enter a buffer that holds ``held``."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    room = max(0, capacity - held)
    if policy == "inline" or arriving <= room:
        return Decision(arriving)
    if policy == "reject":
        return Decision(0, rejected=True)
    if policy == "block":
        return Decision(0, wait=True)
    if policy == "drop_newest":
        return Decision(room, dropped=arriving - room)
    enter = min(arriving, capacity)
    return Decision(enter, evict=max(0, held + enter - capacity), dropped=arriving - enter)


def accept(rows: DataFrame, source: str, declared: dict[str, str], now: int, unknown: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows: declared kinds, ``_ts`` honoured or stamped, ``_source`` overwritten."""
    extra = [c for c in rows.columns if c not in declared and c not in ("_ts", "_seq", "_retract")]
    if unknown == "reject" and extra:
        raise ValueError(f"unknown fields: {', '.join(extra)}")
    rows = rows.drop(*extra)
    kept = coerce(rows, declared, "null")
    bad = F.lit(False)
    tagged = rows.select(F.struct(*rows.columns).alias("_raw"), "*")
    both = coerce(tagged, declared, "null")
    for c in declared:
        if c in rows.columns:
            bad = bad | (F.col(f"_raw.{c}").isNotNull() & F.col(c).isNull())
    stamp = F.coalesce(F.col("_ts").cast("bigint"), F.lit(now)) if "_ts" in kept.columns else F.lit(now)
    good = both.filter(~bad).drop("_raw").withColumn("_ts", stamp.cast("bigint")).withColumn("_source", F.lit(source))
    return good, both.filter(bad).select("_raw.*")
