"""Weighted deltas: tables as bags of rows with integer weights.

A delta frame has the columns of its table and ``_weight`` (+1 asserts, -1
retracts).  Linear operators work on deltas alone; bilinear ones on a delta
against a state.  A row's identity is all of its columns, ``_ts`` and ``_source``
with them; it is visible while its net weight is positive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

W = "_weight"


def as_deltas(rows: DataFrame) -> DataFrame:
    """Rows as deltas: ``_retract`` true turns a row into a retraction."""
    weight = F.coalesce(F.col(W), F.lit(1)) if W in rows.columns else F.lit(1)
    if "_retract" in rows.columns:
        weight = F.when(F.coalesce(F.col("_retract"), F.lit(False)), F.lit(-1)).otherwise(weight)
    return rows.withColumn(W, weight.cast("bigint")).drop("_retract")


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != W]


def net(deltas: DataFrame) -> DataFrame:
    """One row per identity with its net weight; zeros go, debts stay."""
    keys = [F.col(f"`{c}`") for c in columns(deltas)]
    return deltas.groupBy(*keys).agg(F.sum(W).alias(W)).filter(F.col(W) != 0).select(*deltas.columns)


def plus(*deltas: DataFrame) -> DataFrame:
    out = deltas[0]
    for d in deltas[1:]:
        out = out.unionByName(d)
    return out


def negate(deltas: DataFrame) -> DataFrame:
    return deltas.withColumn(W, -F.col(W))


def snapshot(deltas: DataFrame) -> DataFrame:
    """The visible rows, each once."""
    return net(deltas).filter(F.col(W) > 0).drop(W)


def current(changes: DataFrame) -> DataFrame:
    """The rows that asserts and retractions (``_weight``, ``_retract``) leave, each as often as it weighs.

    A retraction names a row by all columns but its own arrival, ``_seq``; of equal rows the latest arrival is kept."""
    deltas = as_deltas(changes)
    keys = [F.col(f"`{c}`") for c in columns(deltas) if c != "_seq"]
    left = deltas.groupBy(*keys).agg(F.sum(W).alias(W), F.max("_seq").alias("_seq")).filter(F.col(W) > 0)
    return left.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(W)))).drop("_n", W)


def attach(state: DataFrame, epoch: int, changes: DataFrame) -> DataFrame:
    """What a late reader sees: the state as of ``epoch`` as asserts, then the changes (``_epoch``) after it."""
    base = state.withColumn(W, F.lit(1).cast("bigint"))
    return base.unionByName(changes.filter(F.col("_epoch") > epoch).drop("_epoch"))


def supersede(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a reader of keyed deltas (``_seq``) holds: per key the last assert, unless the key's
    net weight is gone."""
    row = F.struct(*[c for c in columns(deltas) if c != "_seq"])
    last = F.max_by(row, F.when(F.col(W) > 0, F.col("_seq")))
    held = deltas.groupBy(*[F.col(f"`{k}`").alias(f"_key_{k}") for k in keys]).agg(F.sum(W).alias("_net"), last.alias("r"))
    return held.filter("_net > 0 and r is not null").select("r.*")


def bag(deltas: DataFrame) -> DataFrame:
    """The visible rows, each as often as it weighs."""
    visible = net(deltas).filter(F.col(W) > 0)
    return visible.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(W)))).drop("_n", W)


def _times(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    x, y = a.withColumnRenamed(W, "_wa"), b.withColumnRenamed(W, "_wb")
    joined = x.join(y, on, how)
    return joined.withColumn(W, F.col("_wa") * F.col("_wb")).drop("_wa", "_wb")


def join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The change of ``a`` join ``b``: new rows of each side against the other, and against each other."""
    return net(plus(_times(da, b, on), _times(a, db, on).select(*_times(da, b, on).columns), _times(da, db, on).select(*_times(da, b, on).columns)))


def outer_join(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """The snapshot of an outer join of two visible bags, as deltas of weight one each."""
    return as_deltas(bag(a).join(bag(b), on, how))


def _touched(state: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    # A plain semi-join: null keys never match in a join.
    return state.join(keys, on, "left_semi")


def recompute(state: DataFrame, delta: DataFrame, on: list[str], view: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The change of ``view`` by computing the touched keys before and after.

    For operators that aren't linear: aggregates with minima, ``LATEST BY``,
    distinct, outer joins.  ``on`` are columns by which ``view`` is independent."""
    names = {c: f"_k_{c}" for c in on}
    keys = delta.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(names[c]) for c in on], *[F.col(c).isNull().alias(names[c] + "n") for c in on]).distinct()
    tag = lambda df: df.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(names[c]) for c in on], *[F.col(c).isNull().alias(names[c] + "n") for c in on])
    by = [*names.values(), *[n + "n" for n in names.values()]]
    before = _touched(tag(state), keys, by).drop(*by)
    after = plus(before, delta)
    return net(plus(as_deltas(view(bag(after))), negate(as_deltas(view(bag(before))))))


def aggregate_deltas(deltas: DataFrame, by: list[str], sums: dict[str, str], count: str = "n") -> DataFrame:
    """Subtractable aggregates straight from weights: sums and a count, one row per group of positive weight."""
    aggs = [F.coalesce(F.sum(F.col(x) * F.col(W)), F.lit(0)).alias(name) for name, x in sums.items()]
    out = deltas.groupBy(*by).agg(F.sum(W).alias(count), *aggs)
    return out.filter(F.col(count) > 0)


def distinct_change(state: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows whose visibility flips."""
    before, after = net(state), net(plus(state, delta))
    seen = lambda df: df.filter(F.col(W) > 0).withColumn(W, F.lit(1).cast("bigint"))
    return net(plus(seen(after), negate(seen(before))))


def latest_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of arrivals ``_seq`` with ``_ts``, the current row per key.

    An older arrival is ignored, a tie goes to the later one; a key retraction
    (``_retract``) drops the key as it stands then.  Combines before the shuffle."""
    order = F.struct("_ts", "_seq")
    gone = F.coalesce(F.col("_retract"), F.lit(False)) if "_retract" in rows.columns else F.lit(False)
    flagged = rows.withColumn("_gone", gone)
    cleared = flagged.filter("_gone").groupBy(*keys).agg(F.max("_seq").alias("_cleared"))
    live = flagged.filter("not _gone")
    same = None
    for k in keys:
        c = live[k].eqNullSafe(cleared[k])
        same = c if same is None else same & c
    kept = live.join(cleared.select(*keys, "_cleared"), same, "left").filter(F.col("_cleared").isNull() | (F.col("_seq") > F.col("_cleared")))
    kept = kept.select(*[live[c] for c in live.columns]).drop("_gone", "_retract")
    best = kept.groupBy(*[F.col(f"`{k}`").alias(f"_key_{k}") for k in keys]).agg(F.max_by(F.struct(*kept.columns), order).alias("r"))
    return best.select("r.*")


def retain(rows: DataFrame, max_rows: int | None = None, ttl: int | None = None, key: Column | None = None) -> DataFrame:
    """The newest ``max_rows`` by event time, and those not older than ``ttl`` than the newest."""
    if ttl is not None:
        newest = F.broadcast(rows.agg((F.max("_ts") - ttl).alias("_least")))  # one row
        rows = rows.crossJoin(newest).filter(F.col("_ts") >= F.col("_least")).drop("_least")
    if max_rows is not None:
        rows = rows.orderBy(F.desc("_ts"), F.desc(key) if key is not None else F.desc("_seq")).limit(max_rows)
    return rows


HISTORY_LIMIT = 1000


def history(changes: DataFrame, keys: list[str], policy: str = "all", n: int = HISTORY_LIMIT, by: str | None = None) -> DataFrame:
    """Versions of each key among asserts: ``all`` (the newest HISTORY_LIMIT at most), ``last``, ``first`` n, or the row with the least or largest ``by`` and the latest."""
    asserts = changes.filter(F.col(W) > 0).drop(W)
    newest = Window.partitionBy(*keys).orderBy(F.desc("_ts"), F.desc("_seq"))
    oldest = Window.partitionBy(*keys).orderBy("_ts", "_seq")
    if policy in ("all", "last", "first"):
        order = oldest if policy == "first" else newest
        limit = min(n, HISTORY_LIMIT) if policy == "all" else n
        return asserts.withColumn("_v", F.row_number().over(order)).filter(F.col("_v") <= limit).drop("_v")
    pick = F.max_by if policy == "max_by" else F.min_by
    row = F.struct(*asserts.columns)
    both = asserts.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        pick(row, F.col(by)).alias("a"), F.max_by(row, F.struct("_ts", "_seq")).alias("b")
    )
    return both.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("r")).filter("r is not null").select("r.*")
