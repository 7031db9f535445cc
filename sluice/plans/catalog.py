"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sql.parser import references
from .engine import Engine


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_type", "user_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("weight"), "props",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("_ts"), F.col("event_id").alias("_seq"),
    )


def stamp(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    leg = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(leg))).alias("legs"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return load(spark, sf_dir, "orders").select(*cols, stamp("o_orderdate").alias("_ts"), F.col("o_orderkey").alias("_seq"))


#: Relations of the dialect over the driver's tables, and their JSON columns.
ADAPTERS = {
    "ev": (ev, ("props",)),
    "clicks": (lambda s, d: ev(s, d).filter("event_type = 'click'"), ("props",)),
    "purchases": (lambda s, d: ev(s, d).filter("event_type = 'purchase'"), ("props",)),
    "ord": (_orders, ()),
    "li": (lambda s, d: load(s, d, "lineitem").withColumn("_ts", stamp("l_shipdate")).drop("l_shipdate"), ()),
    "structures": (_structures, ("legs",)),
    **{t: (lambda s, d, t=t: load(s, d, t), ()) for t in ("customer", "nation", "region", "supplier", "part")},
}


#: Events are numbered in the order of their time.
CLOCKS = dict.fromkeys(("ev", "clicks", "purchases"), "events")


def disordered(rows: DataFrame) -> DataFrame:
    """Events that arrive in another order than they happened."""
    return rows.withColumn("_seq", F.col("_seq") - F.pmod(F.col("_seq") * 7919, F.lit(97)) * 3)


def engine(spark: SparkSession, sf_dir: str, mode: str = "table", names=tuple(ADAPTERS), shuffled: bool = False) -> Engine:
    """An engine with the named relations; a statement's own are enough for it."""
    g = Engine(spark, mode)
    for name in names:
        if name not in ADAPTERS:
            continue
        build, json = ADAPTERS[name]
        rows = build(spark, sf_dir)
        g.register(name, disordered(rows) if shuffled else rows, json=json, clock=None if shuffled else CLOCKS.get(name))
    return g


EV = """ev AS (SELECT event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS weight, props,
  epoch_us(ts) // 1000 AS _ts, event_id AS _seq FROM events)"""
#: Errors by user and window, and each event with the end of the latest window that had closed.
ERRORS = """w AS (SELECT user_id, _ts - _ts % 21600000 + 21600000 AS e, max(weight) AS m FROM ev WHERE event_type = 'error' GROUP BY 1, 2),
  ends AS (SELECT DISTINCT e FROM w), seen AS (SELECT ev.*, ends.e AS vis FROM ev ASOF LEFT JOIN ends ON ev._ts - 1000 >= ends.e)"""
TABLE, PIPE = "table", "pipeline"
#: The normal distribution by a series of terms of one sign; beyond 8 it is 0 or 1 to 15 digits.
CDF = ("(CASE WHEN abs({x}) > 8 THEN CASE WHEN {x} > 0 THEN 1 ELSE 0 END ELSE 0.5 + ({x}) * exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda n: "
       "exp(n * ln(greatest(({x}) * ({x}), 1e-300)) - list_sum(list_transform(range(0, n + 1), lambda m: ln(2 * m + 1.0)))))) END)")

#: name: (mode, dialect, DuckDB SQL).  Doubles are rounded on both sides: their sums depend on order.
DIALECT: dict[str, tuple[str, str, str | None]] = {
    "tumbling_vwap": (PIPE, """SELECT event_type, ROUND(SUM(value * weight) / SUM(weight), 9) AS vwap, COUNT(*) AS n FROM ev
        GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)""",
        f"""WITH {EV} SELECT event_type, round(sum(value * weight) / nullif(sum(weight), 0), 9) AS vwap, count(*) AS n,
        _ts - _ts % 3600000 AS window_start, _ts - _ts % 3600000 + 3600000 AS window_end FROM ev GROUP BY event_type, _ts - _ts % 3600000"""),
    "filter_project": (PIPE, "SELECT event_type, user_id, ROUND(value * 2 + 1, 4) AS v, weight % 7 AS m FROM ev WHERE value > 50 AND weight != 3",
        f"WITH {EV} SELECT event_type, user_id, round(value * 2 + 1, 4) AS v, weight % 7 AS m FROM ev WHERE value > 50 AND weight <> 3"),
    "three_valued_where": (PIPE, "SELECT user_id, weight FROM ev WHERE NOT (value > 10 AND (CASE WHEN weight > 50 THEN weight END) > 70)",
        f"WITH {EV} SELECT user_id, weight FROM ev WHERE NOT (value > 10 AND (CASE WHEN weight > 50 THEN weight END) > 70)"),
    "cross_kind_compare": (PIPE, "SELECT user_id, IF(event_type = 1, 'same', 'other') AS eq, IF(event_type < 1, 1, 0) AS lt FROM ev WHERE event_type != 5",
        f"WITH {EV} SELECT user_id, 'other' AS eq, 0::BIGINT AS lt FROM ev"),
    "case_cast_coalesce": (PIPE, """SELECT user_id, CASE WHEN value > 75 THEN 'high' WHEN value > 25 THEN 'mid' ELSE 'low' END AS band,
        CAST(value AS LONG) AS whole, COALESCE(CASE WHEN weight > 50 THEN weight END, -1) AS w, TO_STRING(user_id) AS u FROM ev""",
        f"""WITH {EV} SELECT user_id, CASE WHEN value > 75 THEN 'high' WHEN value > 25 THEN 'mid' ELSE 'low' END AS band,
        CAST(trunc(value) AS BIGINT) AS whole, coalesce(CASE WHEN weight > 50 THEN weight END, -1) AS w, CAST(user_id AS VARCHAR) AS u FROM ev"""),
    "division_semantics": (PIPE, "SELECT user_id, weight / 2 AS half, weight / (weight - weight) AS bad, weight % (weight - weight) AS bad2, -weight % 7 AS m FROM ev",
        f"WITH {EV} SELECT user_id, weight / 2.0::DOUBLE AS half, NULL::DOUBLE AS bad, NULL::BIGINT AS bad2, (-weight) % 7 AS m FROM ev"),
    "json_extract": (PIPE, "SELECT event_type, props ->> 'k' AS k, TO_DOUBLE(props -> 'k') AS kd, props -> 'none' AS missing FROM ev",
        f"WITH {EV} SELECT event_type, json_extract_string(props, '$.k') AS k, CAST(weight AS DOUBLE) AS kd, NULL::VARCHAR AS missing FROM ev"),
    "conversions": (PIPE, """SELECT user_id, TO_LONG('12') AS a, TO_LONG('1.5') AS b, TO_DOUBLE('1,234.5') AS c, TO_BOOL('yes') AS d, TO_BOOL('0') AS e,
        TO_STRING(TO_TIMESTAMP('2024-01-02T03:04:05Z')) AS f, UPPER(event_type) AS g, ABS(-weight) AS h FROM ev""",
        f"WITH {EV} SELECT user_id, 12::BIGINT AS a, NULL::BIGINT AS b, 1234.5::DOUBLE AS c, true AS d, false AS e, '2024-01-02T03:04:05.000Z' AS f, upper(event_type) AS g, weight AS h FROM ev"),
    "running_group_by": (TABLE, "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, COUNT(*) AS n, ROUND(AVG(l_discount), 6) AS d FROM li GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY ALL"),
    "group_by_all": (TABLE, "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM ord GROUP BY ALL",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY ALL"),
    "global_agg": (TABLE, "SELECT COUNT(*) AS n, SUM(CASE WHEN o_orderkey < 0 THEN 1 END) AS none FROM ord", "SELECT count(*) AS n, 0::BIGINT AS none FROM orders"),
    "empty_global_agg": (TABLE, "SELECT COUNT(*) AS n FROM ord WHERE o_orderkey < 0", "SELECT count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0"),
    "stat_aggs": (TABLE, "SELECT o_orderpriority, ROUND(VAR_SAMP(o_totalprice), 2) AS vs, ROUND(STDDEV_POP(o_totalprice), 4) AS sp, ROUND(STDDEV(o_totalprice), 4) AS ss FROM ord GROUP BY o_orderpriority",
        "SELECT o_orderpriority, round(var_samp(o_totalprice), 2) AS vs, round(stddev_pop(o_totalprice), 4) AS sp, round(stddev_samp(o_totalprice), 4) AS ss FROM orders GROUP BY ALL"),
    "percentile_cont": (TABLE, "SELECT l_returnflag, ROUND(PERCENTILE_CONT(0.9, l_extendedprice), 4) AS p90, ROUND(MEDIAN(l_quantity), 4) AS med FROM li GROUP BY l_returnflag",
        "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_quantity, 0.5), 4) AS med FROM lineitem GROUP BY ALL"),
    "count_distinct": (TABLE, "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s FROM li GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY ALL"),
    "post_agg": (TABLE, "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 4) AS mean, MAX(o_orderkey) - MIN(o_orderkey) AS spread FROM ord GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS mean, max(o_orderkey) - min(o_orderkey) AS spread FROM orders GROUP BY ALL"),
    "hopping": (PIPE, "SELECT event_type, COUNT(*) AS n, SUM(weight) AS w FROM ev GROUP BY event_type WINDOW HOPPING(SIZE 2 HOURS, ADVANCE BY 30 MINUTES)",
        f"""WITH {EV}, h AS (SELECT *, unnest(range(_ts - _ts % 1800000 - 5400000, _ts + 1, 1800000)) AS ws FROM ev)
        SELECT event_type, count(*) AS n, sum(weight)::BIGINT AS w, ws AS window_start, ws + 7200000 AS window_end FROM h WHERE ws <= _ts AND _ts < ws + 7200000 GROUP BY event_type, ws"""),
    "hopping_gaps": (PIPE, "SELECT COUNT(*) AS n FROM ev WINDOW HOPPING(SIZE 1 HOURS, ADVANCE BY 3 HOURS)",
        f"WITH {EV} SELECT count(*) AS n, _ts - _ts % 10800000 AS window_start, _ts - _ts % 10800000 + 3600000 AS window_end FROM ev WHERE _ts % 10800000 < 3600000 GROUP BY 2, 3"),
    "session": (PIPE, "SELECT user_id, COUNT(*) AS n FROM ev GROUP BY user_id WINDOW SESSION(GAP 6 HOURS)",
        f"""WITH {EV}, a AS (SELECT user_id, _ts, CASE WHEN _ts - lag(_ts) OVER o > 21600000 THEN 1 ELSE 0 END AS cut FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY _ts)),
        b AS (SELECT user_id, _ts, sum(cut) OVER (PARTITION BY user_id ORDER BY _ts RANGE UNBOUNDED PRECEDING) AS g FROM a)
        SELECT user_id, count(*) AS n, min(_ts) AS window_start, max(_ts) AS window_end FROM b GROUP BY user_id, g"""),
    "emit_changes": (PIPE, "SELECT event_type, COUNT(*) AS n, SUM(weight) AS w FROM ev GROUP BY event_type WINDOW TUMBLING(SIZE 6 HOURS) EMIT CHANGES",
        f"""WITH {EV}, w AS (SELECT *, _ts - _ts % 21600000 AS ws FROM ev)
        SELECT event_type, (row_number() OVER o)::BIGINT AS n, (sum(weight) OVER o)::BIGINT AS w, ws AS window_start, ws + 21600000 AS window_end, false AS _final FROM w
        WINDOW o AS (PARTITION BY event_type, ws ORDER BY _seq) UNION ALL
        SELECT event_type, count(*), sum(weight)::BIGINT, ws, ws + 21600000, true FROM w GROUP BY event_type, ws"""),
    "distinct_changes": (PIPE, "SELECT event_type, COUNT(DISTINCT user_id) AS u, COUNT(DISTINCT IF(value > 50, user_id, NULL)) AS v FROM ev GROUP BY event_type WINDOW TUMBLING(SIZE 24 HOURS) EMIT CHANGES",
        f"""WITH {EV}, w AS (SELECT *, _ts - _ts % 86400000 AS ws, CASE WHEN value > 50 THEN user_id END AS x FROM ev),
        f AS (SELECT *, row_number() OVER (PARTITION BY event_type, ws, user_id ORDER BY _seq) = 1 AS a, x IS NOT NULL AND row_number() OVER (PARTITION BY event_type, ws, x ORDER BY _seq) = 1 AS b FROM w)
        SELECT event_type, (sum(a::INT) OVER o)::BIGINT AS u, (sum(b::INT) OVER o)::BIGINT AS v, ws AS window_start, ws + 86400000 AS window_end, false AS _final FROM f
        WINDOW o AS (PARTITION BY event_type, ws ORDER BY _seq) UNION ALL
        SELECT event_type, count(DISTINCT user_id), count(DISTINCT x), ws, ws + 86400000, true FROM w GROUP BY event_type, ws"""),
    "session_changes": (PIPE, "SELECT user_id, COUNT(*) AS n, SUM(weight) AS w FROM ev GROUP BY user_id WINDOW SESSION(GAP 6 HOURS) EMIT CHANGES",
        f"""WITH {EV}, a AS (SELECT user_id, weight, _ts, _seq, CASE WHEN _ts - lag(_ts) OVER o > 21600000 THEN 1 ELSE 0 END AS cut FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY _ts)),
        b AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY _ts RANGE UNBOUNDED PRECEDING) AS g FROM a)
        SELECT user_id, count(*) OVER s AS n, (sum(weight) OVER s)::BIGINT AS w, min(_ts) OVER s AS window_start, max(_ts) OVER s AS window_end, false AS _final
        FROM b WINDOW s AS (PARTITION BY user_id, g ORDER BY _seq ROWS UNBOUNDED PRECEDING) UNION ALL
        SELECT user_id, count(*), sum(weight)::BIGINT, min(_ts), max(_ts), true FROM b GROUP BY user_id, g"""),
    "windows_in_windows": (PIPE, """SELECT MAX(n) AS peak, COUNT(*) AS parts FROM (SELECT event_type, COUNT(*) AS n FROM ev GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)) h
        WINDOW TUMBLING(SIZE 1 DAYS)""".replace("1 DAYS", "24 HOURS"),
        f"""WITH {EV}, h AS (SELECT event_type, count(*) AS n, _ts - _ts % 3600000 + 3600000 AS e FROM ev GROUP BY 1, 3)
        SELECT max(n) AS peak, count(*) AS parts, e - e % 86400000 AS window_start, e - e % 86400000 + 86400000 AS window_end FROM h GROUP BY 3, 4"""),
    "distinct_per_window": (PIPE, "SELECT user_id FROM ev GROUP BY user_id WINDOW TUMBLING(SIZE 12 HOURS)",
        f"WITH {EV} SELECT DISTINCT user_id, _ts - _ts % 43200000 AS window_start, _ts - _ts % 43200000 + 43200000 AS window_end FROM ev"),
    "unnest_agg": (TABLE, "SELECT l.l_orderkey, SUM(x -> 'q') AS q, COUNT(*) AS n FROM structures l, UNNEST(l.legs) AS x GROUP BY l.l_orderkey",
        "SELECT l_orderkey, sum(trunc(l_quantity))::DOUBLE AS q, count(*) AS n FROM lineitem GROUP BY 1"),
    "cte_chain": (TABLE, """WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM ord GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS c FROM a GROUP BY n) SELECT n, c FROM b WHERE n > 2""",
        "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT n, count(*) AS c FROM a GROUP BY 1) SELECT * FROM b WHERE n > 2"),
    "derived_join": (TABLE, """SELECT c.c_mktsegment, SUM(t.n) AS n FROM customer c JOIN (SELECT o_custkey, COUNT(*) AS n FROM ord GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey GROUP BY c.c_mktsegment""",
        "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "union_all": (TABLE, "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
        "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier"),
    "union_distinct": (TABLE, "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "semi_in": (TABLE, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ord WHERE o_totalprice > 300000)",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "anti_not_in_nulls": (TABLE, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT IF(o_orderstatus = 'F', o_custkey, NULL) AS k FROM ord)",
        "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_custkey = c.c_custkey)"),
    "exists": (TABLE, "SELECT n_name FROM nation WHERE EXISTS (SELECT o_orderkey FROM ord WHERE o_totalprice > 1000) AND n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "not_exists": (TABLE, "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT o_orderkey FROM ord WHERE o_totalprice < 0)", "SELECT n_name FROM nation"),
    "scalar_uncorr": (TABLE, "SELECT o_orderkey FROM ord WHERE o_totalprice > (SELECT AVG(o_totalprice) AS a FROM ord) * 1.5",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5"),
    "scalar_corr": (TABLE, "SELECT o.o_orderkey FROM ord o WHERE o.o_totalprice > (SELECT AVG(i.o_totalprice) AS a FROM ord i WHERE i.o_custkey = o.o_custkey) * 1.2",
        "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) * 1.2"),
    "latest_by": (TABLE, "SELECT user_id, event_type, value FROM ev LATEST BY user_id",
        f"WITH {EV} SELECT user_id, event_type, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _ts DESC, _seq DESC) = 1"),
    "latest_by_where": (TABLE, "SELECT user_id, event_type, weight FROM ev WHERE value > 50 LATEST BY (user_id, event_type)",
        f"WITH {EV} SELECT user_id, event_type, weight FROM ev WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY _ts DESC, _seq DESC) = 1"),
    "table_inner": (TABLE, "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 1) AS total FROM ord o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "table_left": (TABLE, "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN ord o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "table_right": (TABLE, "SELECT c.c_custkey, o.o_orderkey FROM ord o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey"),
    "table_full": (TABLE, "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey"),
    "table_residual_outer": (TABLE, "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN ord o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000"),
    "composite_key": (TABLE, "SELECT a.l_orderkey, COUNT(*) AS n FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey",
        "SELECT a.l_orderkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1"),
    "table_cross": (TABLE, "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "interval_inner": (PIPE, "SELECT c.user_id, COUNT(*) AS n FROM clicks c JOIN purchases p WITHIN 6 HOURS ON c.user_id = p.user_id GROUP BY c.user_id WINDOW TUMBLING(SIZE 24 HOURS)",
        f"""WITH {EV}, j AS (SELECT c.user_id, greatest(c._ts, p._ts) AS t FROM ev c JOIN ev p ON c.user_id = p.user_id AND abs(c._ts - p._ts) <= 21600000 WHERE c.event_type = 'click' AND p.event_type = 'purchase')
        SELECT user_id, count(*) AS n, t - t % 86400000 AS window_start, t - t % 86400000 + 86400000 AS window_end FROM j GROUP BY 1, 3, 4"""),
    **{f"interval_{kind}": (PIPE, f"SELECT c.user_id AS cu, c.value AS cv, p.user_id AS pu, p.value AS pv FROM clicks c {kind.upper()} JOIN purchases p WITHIN 2 HOURS ON c.user_id = p.user_id AND p.value > c.value",
        f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), p AS (SELECT * FROM ev WHERE event_type = 'purchase')
        SELECT c.user_id AS cu, c.value AS cv, p.user_id AS pu, p.value AS pv FROM c {kind.upper()} JOIN p ON c.user_id = p.user_id AND p.value > c.value AND abs(c._ts - p._ts) <= 7200000""") for kind in ("left", "right", "full")},
    "interval_cross": (PIPE, "SELECT c.user_id AS a, p.user_id AS b FROM clicks c CROSS JOIN purchases p WITHIN 10 MINUTES",
        f"WITH {EV} SELECT c.user_id AS a, p.user_id AS b FROM ev c JOIN ev p ON abs(c._ts - p._ts) <= 600000 WHERE c.event_type = 'click' AND p.event_type = 'purchase'"),
    "multiway_interval": (PIPE, "SELECT a.user_id, a.value AS av, b.value AS bv, c.value AS cv FROM clicks a JOIN purchases b WITHIN 3 HOURS ON a.user_id = b.user_id JOIN clicks c WITHIN 1 HOURS ON b.user_id = c.user_id",
        f"""WITH {EV} SELECT a.user_id, a.value AS av, b.value AS bv, c.value AS cv FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a._ts - b._ts) <= 10800000
        JOIN ev c ON b.user_id = c.user_id AND abs(greatest(a._ts, b._ts) - c._ts) <= 3600000 WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND c.event_type = 'click'"""),
    "self_join": (PIPE, "SELECT a.user_id, b.value FROM clicks a JOIN clicks b WITHIN 30 MINUTES ON a.user_id = b.user_id", f"WITH {EV} SELECT a.user_id, b.value FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a._ts - b._ts) <= 1800000 WHERE a.event_type = 'click' AND b.event_type = 'click'"),
    "snapshot_in": (PIPE, "SELECT user_id, value FROM ev WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM ev WHERE event_type = 'error' GROUP BY user_id WINDOW TUMBLING(SIZE 6 HOURS))",
        f"WITH {EV}, {ERRORS} SELECT user_id, value FROM seen s WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM w WHERE w.e = s.vis AND w.user_id = s.user_id)"),
    "snapshot_not_in": (PIPE, "SELECT user_id, value FROM ev WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'error' GROUP BY user_id WINDOW TUMBLING(SIZE 6 HOURS))",
        f"WITH {EV}, {ERRORS} SELECT user_id, value FROM seen s WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM w WHERE w.e = s.vis AND w.user_id = s.user_id)"),
    "snapshot_exists": (PIPE, "SELECT user_id, value FROM ev WHERE NOT EXISTS (SELECT user_id FROM ev WHERE event_type = 'error' GROUP BY user_id WINDOW TUMBLING(SIZE 6 HOURS))",
        f"WITH {EV}, {ERRORS} SELECT user_id, value FROM seen WHERE vis IS NULL"),
    "snapshot_scalar": (PIPE, "SELECT user_id, value, (SELECT MAX(x.weight) AS m FROM ev x WHERE x.event_type = 'error' AND x.user_id = ev.user_id WINDOW TUMBLING(SIZE 6 HOURS)) AS m FROM ev WHERE event_type = 'click'",
        f"WITH {EV}, {ERRORS} SELECT s.user_id, s.value, w.m FROM seen s LEFT JOIN w ON w.e = s.vis AND w.user_id = s.user_id WHERE s.event_type = 'click'"),
    "fx_fwd": (TABLE, "SELECT o_orderkey, ROUND(FX_FWD(o_totalprice, 0.05, 0.02, 2), 4) AS f FROM ord", "SELECT o_orderkey, round(o_totalprice * exp((0.05 - 0.02) * 2), 4) AS f FROM orders"),
    "irs_npv": (TABLE, "SELECT o_orderkey, ROUND(IRS_NPV(o_totalprice, 0.03, 10, 0.04, TRUE), 3) AS v FROM ord",
        "SELECT o_orderkey, round(o_totalprice * (1 - pow(1 / 1.04, 10)) - o_totalprice * 0.03 * (1 - pow(1 / 1.04, 10)) / 0.04, 3) AS v FROM orders"),
    "bond_price": (TABLE, "SELECT o_orderkey, ROUND(BOND_PRICE(o_totalprice, 0.05, 10, 0.04, 2), 3) AS v FROM ord",
        "SELECT o_orderkey, round(o_totalprice * 0.025 * (1 - pow(1 / 1.02, 20)) / 0.02 + o_totalprice * pow(1 / 1.02, 20), 3) AS v FROM orders"),
    "irs_dv01": (TABLE, "SELECT o_orderkey, ROUND(IRS_DV01(o_totalprice, 0.03, 10, 0.04, TRUE), 3) AS v FROM ord",
        """WITH p AS (SELECT o_orderkey, o_totalprice AS n, unnest([0.04, 0.0401]::DOUBLE[]) AS y FROM orders),
        v AS (SELECT o_orderkey, y, n * (1 - pow(1 / (1 + y), 10)) - n * 0.03 * (1 - pow(1 / (1 + y), 10)) / y AS v FROM p)
        SELECT o_orderkey, round(abs(max(v) FILTER (y > 0.04) - max(v) FILTER (y = 0.04)), 3) AS v FROM v GROUP BY 1"""),
    "bond_duration": (TABLE, "SELECT o_orderkey, ROUND(BOND_DURATION(o_totalprice, 0.05, 10, 0.04, 2), 6) AS v, ROUND(BOND_DV01(o_totalprice, 0.05, 10, 0.04, 2), 4) AS d FROM ord",
        """WITH f AS (SELECT o_orderkey, o_totalprice AS n, k, CASE WHEN k = 20 THEN 1.025 ELSE 0.025 END * o_totalprice * pow(1.02, -k) AS pv FROM orders, range(1, 21) t(k)),
        m AS (SELECT o_orderkey, sum(pv) AS p, sum(pv * k / 2) / sum(pv) / 1.02 AS d FROM f GROUP BY 1) SELECT o_orderkey, round(d, 6) AS v, round(d * p * 0.0001, 4) AS d FROM m"""),
    **{f"bs_{g}": (TABLE, f"SELECT o_orderkey, ROUND(BS_{g.upper()}(o_totalprice, 150000.0, 1.0, 0.03, 0.01, 0.2, {flag.upper()}), {digits}) AS v FROM ord",
        f"""WITH d AS (SELECT o_orderkey, o_totalprice AS s, (ln(o_totalprice / 150000.0) + (0.03 - 0.01 + 0.02)) / 0.2 AS d1 FROM orders),
        e AS (SELECT *, d1 - 0.2 AS d2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) AS pdf, {1 if flag == 'true' else -1} AS sign FROM d),
        c AS (SELECT *, {CDF.format(x='sign * d1')} AS c1, {CDF.format(x='sign * d2')} AS c2, s * exp(-0.01) AS se, 150000.0 * exp(-0.03) AS ke FROM e)
        SELECT o_orderkey, round({own}, {digits}) AS v FROM c""")
        for g, flag, digits, own in (
            ("price", "true", 3, "sign * (se * c1 - ke * c2)"), ("delta", "false", 8, "sign * exp(-0.01) * c1"), ("gamma", "true", 12, "exp(-0.01) * pdf / (s * 0.2)"),
            ("vega", "true", 3, "se * pdf"), ("theta", "false", 3, "-se * pdf * 0.1 - sign * 0.03 * ke * c2 + sign * 0.01 * se * c1"))},
    "star_expansion": (TABLE, "SELECT * FROM nation", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "star_of_alias": (TABLE, "SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "group_by_expression": (TABLE, "SELECT o_orderkey % 10 AS d, UPPER(o_orderstatus) AS s, COUNT(*) AS n FROM ord GROUP BY o_orderkey % 10, UPPER(o_orderstatus)",
        "SELECT o_orderkey % 10 AS d, upper(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1, 2"),
    "var_pop": (TABLE, "SELECT o_orderpriority, ROUND(VAR_POP(o_totalprice), 2) AS v FROM ord GROUP BY o_orderpriority", "SELECT o_orderpriority, round(var_pop(o_totalprice), 2) AS v FROM orders GROUP BY 1"),
    "whole_numbers_wrap": (TABLE, """SELECT o_orderstatus, SUM(o_orderkey * 4611686018427387904 + 9000000000000000000) AS s, ABS(-9223372036854775807 - 1) AS d, -(-9223372036854775807 - 1) AS m,
        SUM(9000000000000000000) AS big FROM ord GROUP BY o_orderstatus""",
        """WITH t AS (SELECT o_orderstatus, sum((((o_orderkey::HUGEINT * 4611686018427387904) + 9000000000000000000) % 18446744073709551616)) AS s, count(*)::HUGEINT * 9000000000000000000 AS big FROM orders GROUP BY 1)
        SELECT o_orderstatus, ((s + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT AS s, (-9223372036854775808)::BIGINT AS d, (-9223372036854775808)::BIGINT AS m,
        ((big + 9223372036854775808) % 18446744073709551616 - 9223372036854775808)::BIGINT AS big FROM t"""),
    "coalesce_kinds": (TABLE, "SELECT o_orderkey, COALESCE(IF(o_orderkey % 2 = 0, o_custkey, NULL), o_orderstatus) AS v FROM ord",
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE o_orderstatus END AS v FROM orders"),
    "json_null_test": (PIPE, "SELECT user_id, props ->> 'k' AS k FROM ev WHERE (props -> 'k' = NULL) = NULL", f"WITH {EV} SELECT user_id, NULL::VARCHAR AS k FROM ev WHERE false"),
}


def dialect_query(name: str):
    mode, sql, _ = DIALECT[name]
    names = references(sql)
    return lambda spark, sf_dir: engine(spark, sf_dir, mode, names=names).query(sql)


def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = engine(spark, sf_dir, PIPE, names=("ev",), shuffled=True)
    return g.query("SELECT event_type, COUNT(*) AS n FROM ev GROUP BY event_type WINDOW TUMBLING(SIZE 24 HOURS)")


def late_drop_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One watermark over both sides of a join, each out of order."""
    g = engine(spark, sf_dir, PIPE, names=("clicks", "purchases"), shuffled=True)
    return g.query("SELECT c.user_id, c.value AS cv, p.value AS pv FROM clicks c JOIN purchases p WITHIN 6 HOURS ON c.user_id = p.user_id")


LATE = f"""WITH {EV}, s AS (SELECT event_type, _ts, _seq - (_seq * 7919 % 97) * 3 AS q FROM ev),
m AS (SELECT *, max(_ts) OVER (ORDER BY q, 1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS wm FROM s)
SELECT event_type, count(*) AS n, _ts - _ts % 86400000 AS window_start, _ts - _ts % 86400000 + 86400000 AS window_end
FROM m WHERE wm IS NULL OR _ts >= wm GROUP BY 1, 3, 4"""


LATE_BOTH = f"""WITH {EV}, s AS (SELECT *, _seq - (_seq * 7919 % 97) * 3 AS q FROM ev WHERE event_type IN ('click', 'purchase')),
m AS (SELECT *, max(_ts) OVER (ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS wm FROM s),
k AS (SELECT * FROM m WHERE wm IS NULL OR _ts >= wm)
SELECT c.user_id, c.value AS cv, p.value AS pv FROM k c JOIN k p ON c.user_id = p.user_id AND abs(c._ts - p._ts) <= 21600000
WHERE c.event_type = 'click' AND p.event_type = 'purchase'"""


def queries() -> dict:
    return {name: dialect_query(name) for name in DIALECT} | {"late_drop": late_drop, "late_drop_two_sources": late_drop_two_sources}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in DIALECT.items() if sql} | {"late_drop": LATE, "late_drop_two_sources": LATE_BOTH}
