import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.plans import maintain, views
from sluice.plans.engine import Engine

TRADES = "symbol string, price double, qty long, _ts long, _seq long, _weight long"
NAMES = "symbol string, tag string, _ts long, _seq long, _weight long"
LEGS = '[{"q":%d},{"q":2}]'

STATEMENTS = [
    "SELECT symbol, qty * 2 AS q FROM trades WHERE price > 3",
    "SELECT symbol, COUNT(*) AS n, SUM(qty) AS s, MIN(price) AS lo, MEDIAN(price) AS m, COUNT(DISTINCT qty) AS d FROM trades GROUP BY ALL",
    "SELECT COUNT(*) AS n, MAX(qty) AS hi FROM trades WHERE qty > 1",
    "SELECT t.symbol AS s, t.qty AS q, n.tag AS tag FROM trades t JOIN names n ON t.symbol = n.symbol AND t.qty > 2",
    "SELECT t.symbol AS s, t.qty AS q, n.tag AS tag FROM trades t LEFT JOIN names n ON t.symbol = n.symbol",
    "SELECT t.qty AS q, n.symbol AS s, n.tag AS tag FROM trades t RIGHT JOIN names n ON t.symbol = n.symbol WHERE n.tag != 'z'",
    "SELECT t.symbol AS s, t.qty AS q, n.tag AS tag FROM trades t FULL JOIN names n ON t.symbol = n.symbol",
    "SELECT n.tag AS tag, COUNT(*) AS n, SUM(t.qty) AS q FROM trades t JOIN names n ON t.symbol = n.symbol GROUP BY n.tag",
    "SELECT a.symbol AS s, b.tag AS x, c.tag AS y FROM trades a JOIN names b ON a.symbol = b.symbol LEFT JOIN names c ON b.tag = c.symbol",
    "SELECT symbol, qty FROM trades WHERE symbol IN (SELECT symbol FROM names WHERE tag != 'x') AND qty < 5",
    "SELECT symbol, qty FROM trades WHERE symbol NOT IN (SELECT symbol FROM names)",
    "SELECT symbol, COUNT(*) AS n FROM trades WHERE symbol IN (SELECT symbol FROM names GROUP BY symbol) GROUP BY symbol",
    "SELECT symbol AS k, qty AS q FROM trades UNION ALL SELECT tag, 1.5 FROM names",
    "SELECT n, COUNT(*) AS c FROM (SELECT symbol, COUNT(*) AS n FROM trades GROUP BY symbol) d GROUP BY n",
    "WITH big AS (SELECT symbol, MAX(qty) AS m FROM trades GROUP BY symbol) SELECT b.symbol AS s, b.m AS m, n.tag AS t FROM big b LEFT JOIN names n ON b.symbol = n.symbol",
    "SELECT symbol, qty FROM trades WHERE qty > (SELECT AVG(qty) AS a FROM trades)",
    "SELECT symbol FROM trades WHERE NOT EXISTS (SELECT tag FROM names WHERE tag = 'z')",
    "SELECT t.symbol AS s, SUM(x -> 'q') AS q FROM legs t, UNNEST(t.legs) AS x GROUP BY t.symbol",
]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These tables are small: a task each is enough, and compiling plans takes longer than running them."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def batches(seed):
    """Rows of three relations in two batches; about a third take back earlier rows."""
    rng = random.Random(seed)
    held = {"trades": [], "names": [], "legs": []}
    seq = 0
    for _ in range(2):
        out = {}
        for name, rows in held.items():
            changes = []
            for _ in range(rng.randrange(3, 10)):
                seq += 1
                symbol = rng.choice(["a", "b", "c", None])
                if rows and rng.random() < 0.4:
                    changes.append((*rows.pop(rng.randrange(len(rows))), seq, -1))
                    continue
                row = {"trades": (symbol, rng.randrange(1, 9) / 2, rng.randrange(6), 0), "names": (symbol, rng.choice("xyzab"), 0), "legs": (symbol, LEGS % rng.randrange(4), 0)}[name]
                rows.append(row)
                changes.append((*row, seq, 1))
            if changes:
                out[name] = changes
        yield out


SCHEMAS = {"trades": TRADES, "names": NAMES, "legs": "symbol string, legs string, _ts long, _seq long, _weight long"}


def engine(spark, rows):
    e = Engine(spark)
    for name, schema in SCHEMAS.items():
        e.register(name, spark.createDataFrame(rows.get(name, []), schema), json=("legs",))
    return e


@pytest.mark.parametrize("number", range(len(STATEMENTS)))
def test_maintained_views_equal_the_view_over_all_rows(spark, number):
    sql = STATEMENTS[number]
    view, seen = engine(spark, {}).maintain(sql), {}
    net = {}
    for batch in batches(number):
        deltas = view.apply({n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in batch.items()})
        for r in deltas.collect():
            key = tuple(r)[:-2]
            net[key] = net.get(key, 0) + r._weight
        for n, rows in batch.items():
            seen.setdefault(n, []).extend(rows)
    want = bag(engine(spark, seen).query(sql).collect())
    assert bag(view.snapshot().collect()) == want
    assert bag(k for k, w in net.items() for _ in range(w)) == want


def test_latest_by_with_retracted_keys(spark):
    schema = "k string, v long, _ts long, _seq long, _retract boolean"
    sql = "SELECT k, v + 1 AS w FROM t WHERE v > 0 LATEST BY k"
    feed = [
        [("a", 1, 5, 1, None), ("b", 3, 1, 2, None)],
        [("a", 9, 4, 3, None), ("a", 2, 5, 4, None), (None, 4, 1, 5, None)],
        [("a", None, 0, 6, True), ("b", 0, 9, 7, None)],
        [("a", 7, 1, 8, None), ("b", None, 0, 9, True), ("b", 8, 0, 10, None)],
    ]
    view = Engine(spark).register("t", spark.createDataFrame([], schema)).maintain(sql)
    got = []
    for k, rows in enumerate(feed):
        got.append(bag((r.k, r.w, r._weight) for r in view.apply({"t": spark.createDataFrame(rows, schema)}).collect()))
        all_rows = [r for part in feed[: k + 1] for r in part]
        want = Engine(spark).register("t", spark.createDataFrame(all_rows, schema)).query(sql)
        assert bag(view.snapshot().collect()) == bag(want.collect())
    assert got[1] == bag([("a", 2, -1), ("a", 3, 1), (None, 5, 1)]) and got[2] == [("a", 3, -1)]


def test_a_batch_applied_again_and_a_view_opened_again(spark, tmp_path):
    sql = "SELECT symbol, COUNT(*) AS n, MAX(qty) AS hi FROM trades GROUP BY symbol"
    view = engine(spark, {}).maintain(sql, f"file://{tmp_path}/v")
    rows = lambda *r: {"trades": spark.createDataFrame([(s, 1.0, q, 0, 1, 1) for s, q in r], TRADES)}
    view.apply(rows(("a", 1)))
    assert view.apply({}).count() == 0
    for _ in range(2):
        changes = view.apply(rows(("a", 5), ("b", 2)), 2)
        assert bag((r.symbol, r.n, r._weight) for r in changes.collect()) == bag([("a", 1, -1), ("a", 2, 1), ("b", 1, 1)])
    again = engine(spark, {}).maintain(sql, f"file://{tmp_path}/v")
    assert again.number == 3 and bag(again.snapshot().collect()) == [("a", 2, 5), ("b", 1, 2)]
    again.apply(rows(("b", 9)))
    assert bag(again.snapshot().collect()) == [("a", 2, 5), ("b", 2, 9)]


def test_logs_are_rewritten(spark, monkeypatch):
    monkeypatch.setattr(maintain, "COMPACT", 3)
    view = engine(spark, {}).maintain("SELECT symbol, SUM(qty) AS s FROM trades GROUP BY symbol")
    for k in range(6):
        view.apply({"trades": spark.createDataFrame([("a", 1.0, k, 0, k, 1)], TRADES)})
    assert bag(view.snapshot().collect()) == [("a", 15)] and len(view.step.stores["_in"].batches) <= 3


def test_views_follow_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", 1.0, k, 0, k, 1), ("b", 1.0, 2 * k, 0, 9, 1)], TRADES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    view, seen = engine(spark, {}).maintain("SELECT symbol, SUM(qty) AS s FROM trades GROUP BY symbol"), []
    view.follow({"trades": stream}, f"{tmp_path}/log", lambda out, n: seen.append((n, out.count())))
    assert bag(view.snapshot().collect()) == [("a", 3), ("b", 6)] and len(seen) == 3


def test_tasks_of_a_joined_view_are_as_many_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(maintain, "ROWS", 8, raising=False)
    sql = "SELECT t.symbol AS s, t.qty AS q, n.tag AS tag FROM trades t FULL JOIN names n ON t.symbol = n.symbol"
    view = engine(spark, {}).maintain(sql)
    first = {"trades": [(f"s{k}", 1.0, k, 0, k, 1) for k in range(40)], "names": [(f"s{k}", "x", 0, k, 1) for k in range(20, 60)]}
    second = {"trades": [(f"s{k}", 1.0, k, 0, 100 + k, -1) for k in range(0, 40, 2)]}
    make = lambda rows: {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}
    view.apply(make(first))
    # 20 rows come: the joins before and after the batch have 3 tasks each.
    assert view.step.changes(make(second), 1).rdd.getNumPartitions() >= 6
    view.apply(make(second), 1)
    want = engine(spark, {"trades": first["trades"] + second["trades"], "names": first["names"]}).query(sql)
    assert bag(view.snapshot().collect()) == bag(want.collect()) and len(want.collect()) == 50


def test_cuts_are_those_of_ntile_and_no_task_orders_the_events(spark, tmp_path):
    rng = random.Random(3)
    for n, nulls, spread in ((0, 0, 1), (1, 0, 1), (2, 0, 5), (100, 0, 100), (101, 40, 1 << 40), (5000, 7, 1 << 20), (9000, 0, 9000)):
        numbers = [x - spread // 3 for x in rng.sample(range(max(n, spread)), n)]
        rows = spark.createDataFrame([(x,) for x in [*numbers, *[None] * nulls]], "x long")
        tile = sum((F.coalesce(F.col("x") > c, F.lit(False)).cast("int") for c in views.cuts(rows, "x", 3)), F.lit(1))
        assert rows.select(tile.alias("t"), F.ntile(3).over(Window.orderBy("x")).alias("w")).filter("t != w").count() == 0, n
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/events.parquet")
    plan = views._events_in_batches(spark, f"file://{tmp_path}")["ev"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_grouped_view_is_read_and_netted_in_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(maintain, "ROWS", 8, raising=False)
    view = engine(spark, {}).maintain("SELECT symbol, SUM(qty) AS s FROM trades GROUP BY symbol")
    rows = [(f"s{k}", 1.0, k, 0, k, 1) for k in range(60)]
    for _ in range(2):
        view.apply({"trades": spark.createDataFrame(rows, TRADES)})
    # The view's log has 60 rows of the first batch and 60 or 120 of the second.
    assert view.snapshot().rdd.getNumPartitions() >= 15
    # s0 has 0 either way.
    assert bag(view.snapshot().collect()) == bag((f"s{k}", 2 * k) for k in range(60))


def test_a_side_without_rows_is_seen_to_be_empty(spark):
    none = engine(spark, {}).maintain("SELECT symbol FROM trades").view.empty({"symbol": "string", "qty": "long"})
    assert none.dtypes == [("symbol", "string"), ("qty", "bigint"), ("_ts", "bigint"), ("_seq", "bigint")]
    assert none._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation" and none.count() == 0


def test_held_rows_of_a_semi_join_are_netted_once(spark):
    sql = "SELECT symbol, qty FROM trades WHERE symbol IN (SELECT symbol FROM names WHERE tag != 'x')"
    view = engine(spark, {}).maintain(sql)
    make = lambda k: {"trades": spark.createDataFrame([("a", 1.0, k, 0, k, 1)], TRADES), "names": spark.createDataFrame([("a", "y", 0, k, 1)], NAMES)}
    view.apply(make(1))
    changes = view.step.changes(make(2), 1)
    # What was held comes from a checkpoint: the join before and the join after read no file of it.
    stored = [f for f in changes.inputFiles() if "/batch-0/" in f]
    assert not stored and bag((r.symbol, r.qty) for r in changes.filter("_weight > 0").collect()) == [("a", 1), ("a", 2)]
