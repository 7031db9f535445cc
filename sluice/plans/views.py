"""Registered queries of the view layer: deltas, retention, history, search, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import reads, search, zset
from ..sources import formats, sinks
from ..sql.parser import references
from ..storage import fresh_path
from ..streaming import run as streaming
from ..streaming.lower import StreamEngine
from .catalog import EV, ev, load
from .engine import Engine


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).select("event_type", "user_id", "value", "weight", "_ts", "_seq")


def zset_consolidate(spark, sf_dir):
    """Purchases assert a user and weight, errors retract them."""
    rows = _ev(spark, sf_dir).filter("event_type in ('purchase', 'error')")
    deltas = rows.select("user_id", (F.col("weight") % 5).alias("w"), F.when(F.col("event_type") == "error", -1).otherwise(1).cast("bigint").alias("_weight"))
    return zset.net(deltas).withColumnRenamed("_weight", "net")


def zset_incremental_join(spark, sf_dir):
    """The join of orders and customers, of which a tenth arrive as deltas."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.lit(1).cast("bigint").alias("_weight"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", F.lit(1).cast("bigint").alias("_weight"))
    new = F.pmod(F.col("k"), F.lit(10)) == 0
    late = F.pmod(F.col("o_orderkey"), F.lit(10)) == 0
    a, da, b, db = o.filter(~late), o.filter(late), c.filter(~new), c.filter(new)
    whole = zset.plus(zset._times(a, b, ["k"]), zset.join_delta(a, da, b, db, ["k"]))
    return zset.bag(whole).select("k", "o_orderkey", "c_name")


def zset_incremental_agg(spark, sf_dir):
    """Minima per customer after a tenth of the orders were retracted, by recomputing touched keys."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.lit(1).cast("bigint").alias("_weight"))
    gone = zset.negate(o.filter("v % 10 = 0"))
    view = lambda df: df.groupBy("k").agg(F.min("v").alias("lo"), F.count("*").alias("n"))
    change = zset.recompute(o, gone, ["k"], view)
    return zset.snapshot(zset.plus(zset.as_deltas(view(o.drop("_weight"))), change))


def key_retraction(spark, sf_dir):
    """Errors free a user's key."""
    rows = _ev(spark, sf_dir).withColumn("_retract", F.col("event_type") == "error")
    return zset.latest_by(rows, ["user_id"]).select("user_id", "event_type", "value")


def retention_maxrows(spark, sf_dir):
    return zset.retain(_ev(spark, sf_dir), max_rows=500).select("user_id", "event_type", "_seq").withColumnRenamed("_seq", "seq")


def retention_ttl(spark, sf_dir):
    return zset.retain(_ev(spark, sf_dir), ttl=86_400_000).select("user_id", "event_type", F.col("_seq").alias("seq"))


def history_lastn(spark, sf_dir):
    rows = zset.as_deltas(_ev(spark, sf_dir))
    return zset.history(rows, ["user_id"], "last", 3).select("user_id", F.col("_seq").alias("seq"))


def history_maxby(spark, sf_dir):
    rows = zset.as_deltas(_ev(spark, sf_dir).withColumn("rank", F.col("value") * 1000 + F.col("_seq") / 1e9))
    return zset.history(rows, ["user_id"], "max_by", by="rank").select("user_id", F.col("_seq").alias("seq"))


def search_exact(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return search.search(parts, F.col("p_type"), F.col("p_partkey"), "promo", limit=50).select("p_partkey", "p_type")


def history_firstn(spark, sf_dir):
    """The first two versions of a user."""
    rows = zset.as_deltas(_ev(spark, sf_dir))
    return zset.history(rows, ["user_id"], "first", 2).select("user_id", F.col("_seq").alias("seq"))


def search_fuzzy(spark, sf_dir):
    """All types near a misspelt word."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    found = search.search(parts, F.col("p_type"), F.col("p_partkey"), "economi", limit=None, fuzzy=True)
    return found.select("p_partkey", "p_type", F.round("_score", 6).alias("score"))


def upsert_sink(spark, sf_dir):
    """The table that the last delta of each user leaves; errors are deletions."""
    rows = _ev(spark, sf_dir).select("user_id", "event_type", "_seq", F.when(F.col("event_type") == "error", -1).otherwise(1).alias("_weight"))
    return sinks.upsert_plan(rows, ["user_id"])[0]


def cdc_unwrap(spark, sf_dir):
    """Orders wrapped in change envelopes and unwrapped again."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    image = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    deleted = F.col("o_orderkey") % 7 == 0
    event = F.struct(F.when(deleted, "d").otherwise("c").alias("op"), F.when(deleted, image).alias("before"), F.when(~deleted, image).alias("after"), F.lit(5).alias("ts_ms"))
    rows = formats.unwrap_cdc(o.select(F.to_json(event).alias("j")), "j", {"id": "long", "status": "string"})
    return rows.select("id", "status", F.col("_op").alias("op"), F.col("_weight").alias("w"))


def dedup_by_key(spark, sf_dir):
    return formats.dedup(_ev(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type", F.col("_seq").alias("seq"))


def _stream(spark, sf_dir, condition: str = "true") -> DataFrame:
    e = streaming.stream(spark, sf_dir, load(spark, sf_dir, "events").schema, "events.parquet").filter(condition)
    return e.select("event_type", "user_id", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("_ts"), F.col("event_id").alias("seq"), F.col("event_id").alias("_seq"))


def streamed(sql: str):
    """A statement over the events as streams, run to their end."""

    def run(spark, sf_dir):
        streams = StreamEngine(spark)
        for name, condition in (("ev", "true"), ("clicks", "event_type = 'click'"), ("purchases", "event_type = 'purchase'")):
            if name in references(sql):
                streams.register(name, _stream(spark, sf_dir, condition))
        return streams.run(sql, "q")

    return run


STREAMED = {
    "stream_filter": "SELECT user_id, value FROM ev WHERE event_type = 'error' AND value > 50",
    "stream_tumbling": "SELECT event_type, COUNT(*) AS n FROM ev GROUP BY event_type WINDOW TUMBLING(SIZE 1 HOURS)",
    "stream_hopping": "SELECT event_type, COUNT(*) AS n, SUM(seq) AS s FROM ev WHERE value > 20 GROUP BY event_type WINDOW HOPPING(SIZE 2 HOURS, ADVANCE BY 30 MINUTES)",
    "stream_session": "SELECT user_id, COUNT(*) AS n FROM ev GROUP BY user_id WINDOW SESSION(GAP 6 HOURS)",
    "stream_interval_join": "SELECT c.seq AS a, p.seq AS b FROM clicks c JOIN purchases p WITHIN 2 HOURS ON c.user_id = p.user_id",
    "stream_interval_left": "SELECT c.seq AS a, p.seq AS b FROM clicks c LEFT JOIN purchases p WITHIN 2 HOURS ON c.user_id = p.user_id",
    "stream_interval_full": "SELECT c.seq AS a, p.seq AS b FROM clicks c FULL JOIN purchases p WITHIN 2 HOURS ON c.user_id = p.user_id",
    "stream_join_window": "SELECT c.user_id, COUNT(*) AS n FROM clicks c JOIN purchases p WITHIN 6 HOURS ON c.user_id = p.user_id GROUP BY c.user_id WINDOW TUMBLING(SIZE 24 HOURS)",
}


def stream_latest_by(spark, sf_dir):
    """A view of the latest event of each user, maintained micro-batch by micro-batch."""
    shown = load(spark, sf_dir, "events").limit(0)
    empty = shown.select("event_type", "user_id", "value", F.lit(0).cast("bigint").alias("_ts"), F.col("event_id").alias("seq"), F.col("event_id").alias("_seq"))
    view = Engine(spark).register("ev", empty).maintain("SELECT user_id, event_type, seq FROM ev LATEST BY user_id")
    view.follow({"ev": _stream(spark, sf_dir)}, fresh_path(spark, "log"))
    return view.snapshot()


def maintained(sql: str, feeds):
    """A view after three batches of changes; ``feeds``: from the session and folder to relations with ``_batch`` and ``_weight``."""

    def run(spark, sf_dir):
        rows = feeds(spark, sf_dir)
        e = Engine(spark)
        for name, df in rows.items():
            e.register(name, df.limit(0).drop("_batch"))
        view = e.maintain(sql)
        for k in range(3):
            view.apply({name: df.filter(F.col("_batch") == k).drop("_batch") for name, df in rows.items()})
        return view.snapshot()

    return run


#: Counts that one round of ``cuts`` brings to the driver.
CELLS = 4096


def cuts(rows: DataFrame, column: str, parts: int) -> list[int]:
    """The largest number of each tile but the last, where NTILE cuts the distinct whole numbers of a column (nulls first) into ``parts`` tiles.

    Counts by cells of numbers narrow the range that holds a cut, so no task orders the rows."""
    x = F.col(f"`{column}`")
    lo, hi, n, known = rows.agg(F.min(x), F.max(x), F.count("*"), F.count(x)).first()
    if lo is None:
        return [0] * (parts - 1)
    out, rank = [], 0
    for k in range(parts - 1):
        rank += n // parts + (k < n % parts)
        a, b, below = lo, hi, n - known
        while rank > below and a < b:
            width = -(-(b - a + 1) // CELLS)
            cell = F.expr(f"(`{column}` - ({a}L)) div {width}L").alias("c")
            found = rows.filter(x.between(a, b)).groupBy(cell).count().collect()
            for c, own in sorted(map(tuple, found)):
                if below + own >= rank:
                    a, b = a + c * width, min(b, a + (c + 1) * width - 1)
                    break
                below += own
        out.append(a if rank > below else lo - 1)
    return out


def _orders_in_batches(spark, sf_dir):
    """Orders come in two batches; the third takes back a seventh of them.  Customers come in the first and the last."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(0).cast("bigint").alias("_ts"), F.col("o_orderkey").alias("_seq"))
    weigh = lambda df, batch, w: df.withColumn("_batch", batch).withColumn("_weight", F.lit(w).cast("bigint"))
    gone = weigh(o.filter("o_orderkey % 7 = 0"), F.lit(2), -1)
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(0).cast("bigint").alias("_ts"), F.col("c_custkey").alias("_seq"))
    return {
        "o": weigh(o, (F.col("o_orderkey") % 2).cast("int"), 1).unionByName(gone),
        "c": weigh(c, F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(0), 1),
    }


def _only(name: str):
    return lambda spark, sf_dir: {name: _orders_in_batches(spark, sf_dir)[name]}


def _events_in_batches(spark, sf_dir):
    """Events in three batches; an error takes its user's key back."""
    rows = _ev(spark, sf_dir).withColumn("_retract", F.col("event_type") == "error")
    batch = sum(F.coalesce(F.col("_seq") > cut, F.lit(False)).cast("int") for cut in cuts(load(spark, sf_dir, "events"), "event_id", 3))
    return {"ev": rows.withColumn("_batch", batch)}


def insert_into(spark, sf_dir):
    """What a named sink holds after two statements."""
    e = Engine(spark).register("ord", load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    sink = sinks.FileSink(fresh_path(spark, "sink"), "parquet")
    e.sink("out", sink)
    first = e.query("INSERT INTO out SELECT o_orderkey, o_orderstatus FROM ord WHERE o_orderstatus = 'F'")
    second = e.query("INSERT INTO out SELECT o_orderkey, o_orderstatus FROM ord WHERE o_orderkey % 5 = 0")
    return first.unionByName(second)


def table_ingest(spark, sf_dir):
    """A statement over a table fed with weights: a third of the orders are taken back."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).cast("bigint").alias("_weight"))
    rows = o.unionByName(zset.negate(o.filter("o_orderkey % 3 = 0")))
    return Engine(spark).register("ord", rows).query("SELECT o_orderstatus, COUNT(*) AS n FROM ord GROUP BY o_orderstatus")


def history_minby(spark, sf_dir):
    rows = zset.as_deltas(_ev(spark, sf_dir).withColumn("rank", F.col("value") * 1000 + F.col("_seq") / 1e9))
    return zset.history(rows, ["user_id"], "min_by", by="rank").select("user_id", F.col("_seq").alias("seq"))


def sharded(spark, sf_dir):
    """Events written to eight shards by user, and the rows of three users read from theirs."""
    path = fresh_path(spark, "by-user")
    sinks.write_sharded(_ev(spark, sf_dir), path, ["user_id"], 8)
    parts = [sinks.read_shard(spark, path, {"user_id": k}, 8) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("user_id", F.col("_seq").alias("seq"))


def read_ndjson(spark, sf_dir):
    path = fresh_path(spark, "ndjson")
    load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").write.json(path)
    return formats.coerce(formats.read_json(spark, path), {"p_partkey": "long", "p_brand": "string", "p_size": "long"}).select("p_partkey", "p_brand", "p_size")


def read_csv(spark, sf_dir):
    path = fresh_path(spark, "csv")
    load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.option("header", True).option("sep", ";").csv(path)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_retailprice", T.DoubleType())])
    return formats.read_csv(spark, path, schema)


def json_paths(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.struct(F.col("o_orderstatus").alias("s")).alias("in"))).alias("items"))
    rows = formats.extract(o.select(F.to_json(F.struct("items")).alias("j")), "j", {"k": "$.k", "s": "$['in'].s"}, "$.items[*]")
    return formats.coerce(rows, {"k": "long", "s": "string"})


def read_fix(spark, sf_dir):
    """Orders as tag=value messages and back."""
    o = load(spark, sf_dir, "orders")
    line = F.concat(F.lit("8=FIX.4.4|35=D|11="), F.col("o_orderkey").cast("string"), F.lit("|54="), F.col("o_orderstatus"), F.lit("|10=000|"))
    rows = formats.read_fix(o.select(line.alias("value")), {"11": "k", "54": "s"})
    return formats.coerce(rows, {"k": "long", "s": "string"}).select("k", "s")


def coercion(spark, sf_dir):
    """Rows whose declared kinds don't fit are dropped."""
    rows = load(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.col("o_orderkey").cast("string")).alias("k"), F.col("o_totalprice").cast("string").alias("p"))
    return formats.coerce(rows, {"k": "long", "p": "double"}, "drop")


def row_page(spark, sf_dir):
    return reads.page(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], limit=25, offset=100)


NEWEST = "row_number() OVER (PARTITION BY user_id ORDER BY _ts DESC, _seq DESC)"
VIEWS: dict[str, tuple] = {
    "zset_consolidate": (zset_consolidate, f"WITH {EV} SELECT user_id, weight % 5 AS w, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END)::BIGINT AS net FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2 HAVING net <> 0"),
    "zset_incremental_join": (zset_incremental_join, "SELECT o_custkey AS k, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "zset_incremental_agg": (zset_incremental_agg, "SELECT o_custkey AS k, min(o_orderkey) AS lo, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1"),
    "key_retraction": (key_retraction, f"""WITH {EV}, c AS (SELECT user_id, max(_seq) AS s FROM ev WHERE event_type = 'error' GROUP BY 1)
        SELECT user_id, event_type, value FROM ev LEFT JOIN c USING (user_id) WHERE event_type <> 'error' AND (s IS NULL OR _seq > s) QUALIFY {NEWEST} = 1"""),
    "retention_maxrows": (retention_maxrows, f"WITH {EV} SELECT user_id, event_type, _seq AS seq FROM ev ORDER BY _ts DESC, _seq DESC LIMIT 500"),
    "retention_ttl": (retention_ttl, f"WITH {EV} SELECT user_id, event_type, _seq AS seq FROM ev WHERE _ts >= (SELECT max(_ts) FROM ev) - 86400000"),
    "history_lastn": (history_lastn, f"WITH {EV} SELECT user_id, _seq AS seq FROM ev QUALIFY {NEWEST} <= 3"),
    "history_maxby": (history_maxby, f"""WITH {EV} SELECT user_id, _seq AS seq FROM ev QUALIFY {NEWEST} = 1 UNION
        SELECT user_id, _seq FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value * 1000 + _seq / 1e9 DESC) = 1"""),
    "search_exact": (search_exact, "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%promo%' ORDER BY p_partkey LIMIT 50"),
    "history_firstn": (history_firstn, f"WITH {EV} SELECT user_id, _seq AS seq FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _ts, _seq) <= 2"),
    "search_fuzzy": (search_fuzzy, """WITH t AS (SELECT p_partkey, p_type, lower(p_type) AS w FROM part),
        g AS (SELECT *, list_distinct([substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)]) AS a, list_distinct([substr('  economi ', i, 3) for i in range(1, 9)]) AS b FROM t),
        s AS (SELECT *, greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 1 - levenshtein(w, 'economi') / greatest(length(w), 7)) AS s FROM g)
        SELECT p_partkey, p_type, round(s, 6) AS score FROM s WHERE s >= 0.3"""),
    "upsert_sink": (upsert_sink, f"WITH {EV}, l AS (SELECT user_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _seq DESC) = 1) SELECT * FROM l WHERE event_type <> 'error'"),
    "cdc_unwrap": (cdc_unwrap, "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'd' ELSE 'c' END AS op, (CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END)::BIGINT AS w FROM orders"),
    "dedup_by_key": (dedup_by_key, f"WITH {EV} SELECT user_id, event_type, min(_seq) AS seq FROM ev GROUP BY 1, 2"),
    "stream_latest_by": (stream_latest_by, f"WITH {EV} SELECT user_id, event_type, _seq AS seq FROM ev QUALIFY {NEWEST} = 1"),
    "stream_filter": (streamed(STREAMED["stream_filter"]), f"WITH {EV} SELECT user_id, value FROM ev WHERE event_type = 'error' AND value > 50"),
    "stream_tumbling": (streamed(STREAMED["stream_tumbling"]), f"""WITH {EV} SELECT event_type, count(*) AS n, _ts - _ts % 3600000 AS window_start, _ts - _ts % 3600000 + 3600000 AS window_end
        FROM ev GROUP BY 1, 3, 4"""),
    "stream_hopping": (streamed(STREAMED["stream_hopping"]), f"""WITH {EV}, h AS (SELECT *, unnest(range(_ts - _ts % 1800000 - 5400000, _ts + 1, 1800000)) AS ws FROM ev WHERE value > 20)
        SELECT event_type, count(*) AS n, sum(_seq)::BIGINT AS s, ws AS window_start, ws + 7200000 AS window_end FROM h GROUP BY event_type, ws"""),
    "stream_session": (streamed(STREAMED["stream_session"]), f"""WITH {EV}, a AS (SELECT user_id, _ts, CASE WHEN _ts - lag(_ts) OVER o > 21600000 THEN 1 ELSE 0 END AS cut FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY _ts)),
        b AS (SELECT user_id, _ts, sum(cut) OVER (PARTITION BY user_id ORDER BY _ts RANGE UNBOUNDED PRECEDING) AS g FROM a)
        SELECT user_id, count(*) AS n, min(_ts) AS window_start, max(_ts) AS window_end FROM b GROUP BY user_id, g"""),
    **{f"stream_interval_{name}": (streamed(STREAMED[f"stream_interval_{name}"]), f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), p AS (SELECT * FROM ev WHERE event_type = 'purchase')
        SELECT c._seq AS a, p._seq AS b FROM c {kind} JOIN p ON c.user_id = p.user_id AND abs(c._ts - p._ts) <= 7200000""") for name, kind in (("join", "INNER"), ("left", "LEFT"), ("full", "FULL"))},
    "stream_join_window": (streamed(STREAMED["stream_join_window"]), f"""WITH {EV}, j AS (SELECT c.user_id, greatest(c._ts, p._ts) AS t FROM ev c JOIN ev p ON c.user_id = p.user_id AND abs(c._ts - p._ts) <= 21600000
        WHERE c.event_type = 'click' AND p.event_type = 'purchase') SELECT user_id, count(*) AS n, t - t % 86400000 AS window_start, t - t % 86400000 + 86400000 AS window_end FROM j GROUP BY 1, 3, 4"""),
    "inc_group_by": (maintained("SELECT o_custkey, COUNT(*) AS n, MIN(o_orderkey) AS lo, SUM(o_orderkey) AS s FROM o GROUP BY o_custkey", _only("o")),
        "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS lo, sum(o_orderkey)::BIGINT AS s FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1"),
    "inc_outer_join": (maintained("SELECT c.c_custkey AS c, o.o_orderkey AS o FROM c FULL JOIN o ON c.c_custkey = o.o_custkey", _orders_in_batches),
        "SELECT c_custkey AS c, o_orderkey AS o FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON c_custkey = o_custkey"),
    "inc_join_group": (maintained("SELECT c.c_name AS name, COUNT(*) AS n FROM o JOIN c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_name", _orders_in_batches),
        "SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 AND o_orderstatus = 'F' GROUP BY 1"),
    "inc_semi_anti": (maintained("SELECT c_custkey AS k, 'in' AS side FROM c WHERE c_custkey IN (SELECT o_custkey FROM o WHERE o_orderstatus = 'F') UNION ALL SELECT c_custkey, 'out' FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM o)", _orders_in_batches),
        """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) SELECT c_custkey AS k, 'in' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o WHERE o_orderstatus = 'F')
        UNION ALL SELECT c_custkey, 'out' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o)"""),
    "inc_union_distinct": (maintained("SELECT o_custkey AS k FROM o UNION SELECT c_custkey FROM c", _orders_in_batches), "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 7 <> 0 UNION SELECT c_custkey FROM customer"),
    "inc_latest_by": (maintained("SELECT user_id, event_type, value FROM ev LATEST BY user_id", _events_in_batches), f"""WITH {EV}, c AS (SELECT user_id, max(_seq) AS s FROM ev WHERE event_type = 'error' GROUP BY 1)
        SELECT user_id, event_type, value FROM ev LEFT JOIN c USING (user_id) WHERE event_type <> 'error' AND (s IS NULL OR _seq > s) QUALIFY {NEWEST} = 1"""),
    "insert_into": (insert_into, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0"),
    "table_ingest": (table_ingest, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1"),
    "history_minby": (history_minby, f"""WITH {EV} SELECT user_id, _seq AS seq FROM ev QUALIFY {NEWEST} = 1 UNION
        SELECT user_id, _seq FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value * 1000 + _seq / 1e9) = 1"""),
    "sharded_read": (sharded, f"WITH {EV} SELECT user_id, _seq AS seq FROM ev WHERE user_id IN (1, 2, 3)"),
    "read_ndjson": (read_ndjson, "SELECT p_partkey, p_brand, p_size::BIGINT AS p_size FROM part"),
    "read_csv": (read_csv, "SELECT p_partkey, p_name, p_retailprice FROM part"),
    "json_paths": (json_paths, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders"),
    "read_fix": (read_fix, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders"),
    "coercion_drop": (coercion, "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 4 <> 0"),
    "row_page": (row_page, "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 100"),
}


def queries() -> dict:
    return {name: f for name, (f, _) in VIEWS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in VIEWS.items()}
