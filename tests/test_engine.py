import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sluice.functions import quant
from sluice.plans import catalog, views
from sluice.plans.engine import Engine
from sluice.sources.sinks import CallSink, FileSink, LoopbackSink
from sluice.sql.parser import parse, references, split_sink

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def bag(rows):
    def value(x):
        if x is None or x != x:
            return None
        return int(x) if isinstance(x, float) and x == int(x) else x

    return sorted(repr(tuple(value(x) for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


QUERIES, ORACLES = catalog.queries() | views.queries(), catalog.oracle_sql() | views.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    own = QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert bag(own.select(*columns).collect()) == bag(want)


@pytest.fixture
def trades(spark):
    rows = [("AAPL", 10.0, 10, 1000, 1), ("AAPL", 11.0, 20, 2000, 2), ("MSFT", 5.0, None, 2500, 3)]
    return spark.createDataFrame(rows, "symbol string, price double, qty long, _ts long, _seq long")


def run(engine, sql, *columns):
    return sorted((tuple(r) for r in engine.query(sql).select(*columns).collect()), key=lambda r: [(x is None, x) for x in r])


def test_tumbling_and_hopping_bounds(spark):
    e = Engine(spark, "pipeline").register("visits", spark.createDataFrame([("north", 3, 61_000, 1), ("north", 4, 89_999, 2), ("north", 5, 90_000, 3)], "gate string, people long, _ts long, _seq long"))
    sql = "SELECT gate, SUM(people) AS people FROM visits GROUP BY gate WINDOW TUMBLING(SIZE 30 SECONDS)"
    assert run(e, sql, "gate", "people", "window_start", "window_end") == [("north", 5, 90_000, 120_000), ("north", 7, 60_000, 90_000)]
    hopping = "SELECT COUNT(*) AS n FROM visits WHERE people = 4 WINDOW HOPPING(SIZE 1 MINUTES, ADVANCE BY 20 SECONDS)"
    assert run(e, hopping, "window_start") == [(40_000,), (60_000,), (80_000,)]


def test_windows_before_the_epoch(spark):
    e = Engine(spark, "pipeline").register("t", spark.createDataFrame([(-1, 1), (-10000, 1)], "_ts long, v long"))
    assert run(e, "SELECT COUNT(*) AS n FROM t WINDOW TUMBLING(SIZE 10 SECONDS)", "n", "window_start") == [(2, -10000)]


def test_session_ends_at_last_event(spark):
    e = Engine(spark, "pipeline").register("t", spark.createDataFrame([(0, 1), (5000, 1), (20000, 1)], "_ts long, v long"))
    assert run(e, "SELECT COUNT(*) AS n FROM t WINDOW SESSION(GAP 5 SECONDS)", "window_start", "window_end", "n") == [(0, 5000, 2), (20000, 20000, 1)]


def test_late_rows_are_dropped(spark):
    rows = spark.createDataFrame([(10000, 1), (5000, 2), (9500, 3)], "_ts long, _seq long")
    e = Engine(spark, "pipeline").register("t", rows)
    assert run(e, "SELECT COUNT(*) AS n FROM t WINDOW TUMBLING(SIZE 1 HOURS)", "n") == [(2,)]
    assert run(Engine(spark, "pipeline", lateness=None).register("t", rows), "SELECT COUNT(*) AS n FROM t WINDOW TUMBLING(SIZE 1 HOURS)", "n") == [(3,)]
    ordered = Engine(spark, "pipeline").register("t", rows, clock="log")
    assert run(ordered, "SELECT COUNT(*) AS n FROM t WINDOW TUMBLING(SIZE 1 HOURS)", "n") == [(3,)]


def test_one_watermark_over_the_sources_of_a_statement(spark):
    a = spark.createDataFrame([("x", 1_000, 1), ("x", 5_000, 4)], "k string, _ts long, _seq long")
    b = spark.createDataFrame([("x", 9_000, 2), ("x", 8_500, 3)], "k string, _ts long, _seq long")
    e = Engine(spark, "pipeline").register("a", a).register("b", b)
    # The second row of a is late by b's watermark; alone it isn't.
    assert len(run(e, "SELECT a.k AS k FROM a JOIN b WITHIN 1 HOURS ON a.k = b.k", "k")) == 2
    assert len(run(e, "SELECT k FROM a", "k")) == 2


def test_insert_into_writes_to_the_named_sink(spark, trades, tmp_path):
    sink = FileSink(f"{tmp_path}/{{name}}", "csv", columns=["symbol", "none"], name="out")
    e = Engine(spark).register("trades", trades).sink("out", sink).sink("back", LoopbackSink(None, "echo", f"{tmp_path}/echo", depth=2))
    e.sinks["back"].engine = e
    assert e.validate("INSERT INTO nope SELECT symbol FROM trades")[0].message == "Unknown sink 'nope'"
    for text in ("INSERT trades SELECT symbol FROM trades", "INSERT INTO SELECT symbol FROM trades", "INSERT INTO out VALUES (1)"):
        assert e.validate(text)
    e.query("INSERT INTO out SELECT symbol, qty FROM trades WHERE qty > 5")
    e.query("-- twice\nINSERT INTO out\nSELECT symbol FROM trades WHERE price = 5")
    got = spark.read.option("header", True).csv(f"{tmp_path}/out/*")
    assert got.columns == ["symbol", "none"] and sorted(r.symbol for r in got.collect()) == ["AAPL", "AAPL", "MSFT"] and sink.dropped == 1
    e.query("INSERT INTO back SELECT symbol FROM trades WHERE price = 5")
    e.query("INSERT INTO back SELECT symbol, _step FROM echo")
    e.query("INSERT INTO back SELECT symbol, _step FROM echo")
    assert run(e, "SELECT symbol, _step FROM echo", "_step") == [(1,), (2,), (2,)]
    sent = []
    e.sink("call", CallSink(lambda rows: sent.extend(rows.collect()))).query("INSERT INTO call SELECT symbol FROM trades")
    assert len(sent) == 3


def test_tables_take_weights_and_retractions(spark):
    rows = [("a", 1, 1, 1, 1), ("a", 1, 1, 2, -1), ("b", 2, 2, 3, 2), ("c", 3, 3, 4, -1)]
    e = Engine(spark).register("t", spark.createDataFrame(rows, "k string, v long, _ts long, _seq long, _weight long"))
    assert run(e, "SELECT k, v FROM t", "k", "v") == [("b", 2), ("b", 2)]
    rows = [("a", 1, 5, 1, None), ("a", None, 0, 2, True), ("b", 7, 1, 3, None), ("b", 8, 2, 4, None)]
    e.register("u", spark.createDataFrame(rows, "k string, v long, _ts long, _seq long, _retract boolean"))
    assert run(e, "SELECT k, v FROM u WHERE v > 0 LATEST BY k", "k", "v") == [("b", 8)]


def test_names_that_meet_and_statements_that_fail(spark):
    e = Engine(spark).register("a", spark.createDataFrame([(1, 2)], "k long, b_c long")).register("a_b", spark.createDataFrame([(1, 3)], "k long, c long"))
    assert run(e, "SELECT a.b_c AS x, a_b.c AS y FROM a JOIN a_b ON a.k = a_b.k", "x", "y") == [(2, 3)]
    assert "named 'k'" in e.validate("SELECT k, b_c AS k FROM a")[0].message
    assert "nested" in e.validate(f"SELECT {'(' * 400}k{')' * 400} AS x FROM a")[0].message
    j = Engine(spark).register("t", spark.createDataFrame([('{"a": 1}',)], "p string"), json=("p",))
    for x in ("p + 1", "1 * p", "p -> 'a' < 2", "p = 1"):
        assert "JSON" in j.validate(f"SELECT {x} AS v FROM t")[0].message
    assert j.validate("SELECT (p = NULL) AS v FROM t") == [] and run(j, "SELECT p ->> 'a' AS v FROM t", "v") == [("1",)]


def test_elements_of_arrays_are_read_by_kind(spark):
    legs = '[{"q":1.5,"s":"x","o":{"z":[1]},"n":null},{"q":"7"},5,"t"]'
    e = Engine(spark).register("t", spark.createDataFrame([(legs,)], "legs string"), json=("legs",))
    q = "SELECT x -> 'q' AS q, x ->> 'q' AS t, x ->> 's' AS s, x -> 'o' -> 'z' ->> 0 AS z, x ->> 'n' AS n, x AS whole, SUM_OF AS one FROM (SELECT legs, 1 AS SUM_OF FROM t) d, UNNEST(d.legs) AS x"
    got = run(e, q, "q", "t", "s", "z", "n", "whole")
    assert sorted(got, key=repr) == sorted([("1.5", "1.5", "x", "1", None, '{"n":null,"o":{"z":[1]},"q":1.5,"s":"x"}'), ('"7"', "7", None, None, None, '{"q":"7"}'), (None, None, None, None, None, "5"), (None, None, None, None, None, '"t"')], key=repr)
    assert run(e, "SELECT SUM(x -> 'q') AS s, MAX(x -> 'q') AS m FROM t, UNNEST(t.legs) AS x", "s", "m") == [(1.5, 1.5)]


def test_normal_distribution_against_the_library(spark):
    xs = [k / 7 for k in range(-70, 71)] + [0.0, 1e-9, 37.0, -37.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", quant.cdf(F.col("x")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-13, abs=1e-300) for r in got)


def test_expression_semantics(spark, trades):
    e = Engine(spark, "table").register("trades", trades)
    one = lambda x: run(e, f"SELECT {x} AS v FROM trades WHERE symbol = 'MSFT'", "v")[0][0]
    assert one("1 / 0") is None and one("7 / 2") == 3.5 and one("5 % 0") is None and one("-7 % 3") == -1
    assert one("'a' = 1") is False and one("'a' != 1") is True and one("'a' < 1") is None
    assert one("qty = NULL") is None and one("NOT (qty > 1)") is None
    assert one("9223372036854775807 + 1") == -(1 << 63)
    assert one("TO_LONG('1.5')") is None and one("TO_LONG(' 12 ')") == 12 and one("TO_DOUBLE('1,234.5')") == 1234.5
    assert one("TO_STRING(2.0)") == "2" and one("TO_STRING(2.5)") == "2.5"
    assert one("TO_BOOL('yes')") is True and one("TO_BOOL('')") is False and one("'it''s'") == "it's"
    assert one("CASE WHEN price > 100 THEN 1 END") is None and one("COALESCE(qty, 7)") == 7
    assert run(e, "SELECT SUM(qty) AS s FROM trades WHERE symbol = 'MSFT'", "s") == [(0,)]
    assert run(e, "SELECT SUM(qty) AS s FROM trades WHERE symbol = 'none'", "s") == []


def test_latest_by_ties_go_to_the_later_arrival(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1), ("a", 2, 5, 2), ("a", 3, 4, 3), ("b", 4, 1, 4)], "k string, v long, _ts long, _seq long")
    e = Engine(spark).register("t", rows)
    assert run(e, "SELECT k, v FROM t LATEST BY k", "k", "v") == [("a", 2), ("b", 4)]


def test_union_distinct_keeps_event_times_apart(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2)], "k string, _ts long")
    e = Engine(spark).register("a", a)
    assert run(e, "SELECT k FROM a s UNION SELECT k FROM a s", "k") == [("x",), ("x",)]


def test_unnest_of_null_empty_and_other(spark):
    rows = spark.createDataFrame([(1, '[{"q":1},{"q":2}]'), (2, "[]"), (3, None), (4, '{"q":1}')], "id long, legs string")
    e = Engine(spark).register("t", rows, json=("legs",))
    assert run(e, "SELECT t.id, SUM(x -> 'q') AS q FROM t, UNNEST(t.legs) AS x GROUP BY t.id", "id", "q") == [(1, 3.0)]
    assert run(e, "SELECT t.id, SUM(x ->> 'q') AS q FROM t, UNNEST(t.legs) AS x GROUP BY t.id", "id", "q") == [(1, 0)]


@pytest.mark.parametrize(
    "mode, sql, part",
    [
        ("table", "SELECT nope FROM trades", "Unknown column"),
        ("table", "SELECT symbol FROM nope", "Unknown relation"),
        ("table", "SELECT symbol, COUNT(*) FROM trades GROUP BY price", "neither grouped"),
        ("table", "SELECT a.symbol FROM trades a JOIN trades b WITHIN 1 SECONDS ON a.symbol = b.symbol", "WITHIN"),
        ("pipeline", "SELECT a.symbol FROM trades a JOIN trades b ON a.symbol = b.symbol", "WITHIN"),
        ("pipeline", "SELECT COUNT(*) FROM trades", "WINDOW"),
        ("table", "SELECT SUM(COUNT(*)) FROM trades", "nested"),
        ("table", "SELECT symbol FROM trades a JOIN trades b ON a.price > b.price", "equality"),
        ("table", "SELECT symbol FROM trades UNION SELECT symbol FROM trades UNION ALL SELECT symbol FROM trades", "mixed"),
        ("table", "SELECT * FROM trades GROUP BY symbol", "GROUP BY"),
        ("table", "SELECT symbol FROM trades WHERE symbol IN (1, 2)", "subquery"),
        ("table", "SELECT # FROM trades", "Unexpected character"),
    ],
)
def test_diagnostics(spark, trades, mode, sql, part):
    found = Engine(spark, mode).register("trades", trades).validate(sql)
    assert found and part in found[0].message and found[0].line == 1


def test_front_end_helpers():
    assert split_sink("INSERT INTO out SELECT a FROM t") == ("out", "SELECT a FROM t")
    assert references("WITH c AS (SELECT a FROM t) SELECT a FROM c JOIN u ON c.a = u.a WHERE a IN (SELECT b FROM v)") == ["t", "u", "v"]
    assert references("SELECT") == [] and parse("SELECT a -> 'b' ->> 0 AS x FROM t -- end").items[0].alias == "x"


def test_pricing_identities(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1,)], "i long"))
    one = lambda x: run(e, f"SELECT {x} AS v FROM t", "v")[0][0]
    call, put = one("BS_PRICE(100, 95, 2, 0.03, 0.01, 0.25, TRUE)"), one("BS_PRICE(100, 95, 2, 0.03, 0.01, 0.25, FALSE)")
    assert call - put == pytest.approx(100 * math.exp(-0.02) - 95 * math.exp(-0.06))
    assert one("BS_PRICE(100, 95, 0, 0.03, 0.01, 0.25, TRUE)") is None and one("BS_DELTA('x', 95, 1, 0, 0, 0.2, TRUE)") is None
    assert one("BOND_PRICE(100, 0.05, 10, 0.05, 2)") == pytest.approx(100.0)
    assert one("BOND_DV01(100, 0.05, 10, 0.05, 2)") == pytest.approx(one("BOND_DURATION(100, 0.05, 10, 0.05, 2)") * 0.01)
    assert one("IRS_NPV(100, 0.04, 5, 0.04, TRUE)") == pytest.approx(0.0, abs=1e-9)


def test_same_result_for_any_partitioning(spark):
    sql = catalog.DIALECT["table_left"][1]
    out = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(bag(catalog.engine(spark, SF).query(sql).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_interval_join_is_no_cartesian_product_and_scans_prune(spark):
    text = catalog.queries()["interval_inner"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    plan = catalog.queries()["count_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_registered_functions(spark, trades):
    from sluice.functions.registry import Aggregate, Scalar

    e = Engine(spark).register("trades", trades)
    e.registry.register(Scalar("TWICE", (1,), lambda kinds: kinds[0], lambda a: a[0].col * 2))
    e.registry.register(Aggregate("PRODUCT_OF", "double", lambda c: F.product(c)))
    assert run(e, "SELECT symbol, PRODUCT_OF(TWICE(price)) AS p FROM trades GROUP BY symbol", "symbol", "p") == [("AAPL", 440.0), ("MSFT", 10.0)]
    with pytest.raises(ValueError):
        e.registry.register(Scalar("ABS", (1,), lambda kinds: "long", lambda a: a[0].col))
    assert "TWICE" in e.registry.names() and "BS_PRICE" in e.registry.names()


def test_views_in_any_order_and_row_identity(spark, trades):
    e = Engine(spark).register("trades", trades)
    e.create_all({"b": "SELECT n FROM a WHERE n > 1", "a": "SELECT symbol, COUNT(*) AS n FROM trades GROUP BY symbol"})
    assert run(e, "SELECT n FROM b", "n") == [(2,)]
    with pytest.raises(ValueError, match="circle"):
        e.create_all({"x": "SELECT n FROM y", "y": "SELECT n FROM x"})
    assert Engine.identity("SELECT symbol AS s, COUNT(*) AS n FROM trades GROUP BY symbol") == ["s"]
    assert Engine.identity("SELECT symbol, qty, COUNT(*) AS n FROM trades GROUP BY ALL") == ["symbol", "qty"]
    assert Engine.identity("SELECT price FROM trades LATEST BY symbol") is None and Engine.identity("SELECT price FROM trades") is None


def test_changes_of_sessions(spark):
    e = Engine(spark, "pipeline").register("t", spark.createDataFrame([(0, 1), (5000, 2), (20000, 3)], "_ts long, _seq long"))
    sql = "SELECT COUNT(*) AS n FROM t WINDOW SESSION(GAP 5 SECONDS) EMIT CHANGES"
    want = [(0, 0, 1, False), (0, 5000, 2, False), (0, 5000, 2, True), (20000, 20000, 1, False), (20000, 20000, 1, True)]
    assert run(e, sql, "window_start", "window_end", "n", "_final") == want
