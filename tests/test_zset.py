import random

import pytest
from pyspark.sql import functions as F

from sluice.operators import search, zset


def frame(spark, rows, schema="k string, v long, _weight long"):
    return spark.createDataFrame(rows, schema)


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_net_cancels_and_keeps_debt(spark):
    d = frame(spark, [("a", 1, 1), ("a", 1, -1), ("b", 2, 2), ("c", 3, -1)])
    assert bag(zset.net(d)) == [("b", 2, 2), ("c", 3, -1)]
    assert bag(zset.snapshot(d)) == [("b", 2)] and bag(zset.bag(d)) == [("b", 2), ("b", 2)]


def test_join_delta_equals_the_change_of_the_join(spark):
    rng = random.Random(3)
    rows = lambda name: [(rng.choice("abc"), rng.randrange(3), rng.choice((1, 1, -1))) for _ in range(12)]
    make = lambda name: frame(spark, rows(name), f"k string, {name} long, _weight long")
    a, da, b, db = make("v"), make("v"), make("w"), make("w")
    after = zset.net(zset._times(zset.plus(a, da), zset.plus(b, db), ["k"]))
    before = zset.net(zset._times(a, b, ["k"]))
    change = zset.join_delta(a, da, b, db, ["k"])
    assert bag(zset.net(zset.plus(before, change).select("k", "v", "w", "_weight"))) == bag(after.select("k", "v", "w", "_weight"))


@pytest.mark.parametrize("seed", [1, 2])
def test_recompute_equals_the_view_over_everything(spark, seed):
    rng = random.Random(seed)
    state = frame(spark, [(rng.choice(["a", "b", None]), rng.randrange(9), 1) for _ in range(15)])
    delta = zset.plus(zset.negate(state.limit(4)), frame(spark, [("d", 4, 1), (None, 7, 1)]))
    view = lambda df: df.groupBy("k").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
    change = zset.recompute(state, delta, ["k"], view)
    want = view(zset.bag(zset.plus(state, delta)))
    assert bag(zset.snapshot(zset.plus(zset.as_deltas(view(zset.bag(state))), change))) == bag(want)


def test_distinct_change_flips_only(spark):
    state = frame(spark, [("a", 1, 1)])
    assert bag(zset.distinct_change(state, frame(spark, [("a", 1, 1), ("b", 1, 2)]))) == [("b", 1, 1)]
    assert bag(zset.distinct_change(state, frame(spark, [("a", 1, -1)]))) == [("a", 1, -1)]


def test_aggregate_deltas(spark):
    d = frame(spark, [("a", 5, 1), ("a", 2, 1), ("a", 5, -1), ("b", 1, 1), ("b", 1, -1)])
    assert bag(zset.aggregate_deltas(d, ["k"], {"s": "v"})) == [("a", 1, 2)]


def test_latest_by_with_key_retraction(spark):
    rows = spark.createDataFrame(
        [("a", 1, 5, 1, None), ("a", 2, 9, 2, None), ("a", None, 0, 3, True), ("b", 3, 1, 4, None), ("a", 4, 2, 5, None)],
        "k string, v long, _ts long, _seq long, _retract boolean",
    )
    assert bag(zset.latest_by(rows, ["k"]).select("k", "v")) == [("a", 4), ("b", 3)]


def test_retention_and_history(spark):
    rows = spark.createDataFrame([("a", i, 1000 * i, i, 1) for i in range(6)], "k string, v long, _ts long, _seq long, _weight long")
    assert sorted(r.v for r in zset.retain(rows, max_rows=2).collect()) == [4, 5]
    assert sorted(r.v for r in zset.retain(rows, ttl=1500).collect()) == [4, 5]
    assert sorted(r.v for r in zset.history(rows, ["k"], "last", 2).collect()) == [4, 5]
    assert sorted(r.v for r in zset.history(rows, ["k"], "first", 1).collect()) == [0]
    assert sorted(r.v for r in zset.history(rows, ["k"], "min_by", by="v").collect()) == [0, 5]


def test_search(spark):
    rows = spark.createDataFrame([(1, "red apple pie"), (2, "green apples"), (3, "blue plum")], "id long, t string")
    ids = lambda q, **k: [r.id for r in search.search(rows, F.col("t"), F.col("id"), q, **k).collect()]
    assert ids("apple") == [1, 2] and ids("pie red") == [1] and ids("aple") == [] and set(ids("aple", fuzzy=True)) == {1, 2}


def test_late_readers_start_from_a_state(spark):
    state = spark.createDataFrame([("a", 1)], "k string, v long")
    changes = spark.createDataFrame([("a", 1, -1, 6), ("b", 2, 1, 6), ("c", 3, 1, 5)], "k string, v long, _weight long, _epoch long")
    assert [tuple(r) for r in zset.snapshot(zset.attach(state, 5, changes)).collect()] == [("b", 2)]


def test_keyed_readers_hold_the_last_assert(spark):
    rows = [("a", 1, 1, 1), ("a", 1, -1, 2), ("a", 2, 1, 3), ("b", 5, 1, 4), ("b", 5, -1, 5), ("c", 7, 1, 6)]
    deltas = spark.createDataFrame(rows, "k string, v long, _weight long, _seq long")
    assert sorted(tuple(r) for r in zset.supersede(deltas, ["k"]).collect()) == [("a", 2), ("c", 7)]
