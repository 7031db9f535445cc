import json

import pytest
from pyspark.sql import functions as F

from sluice.sources import formats, ingest, sinks


def test_csv_with_sniffed_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name;x\n1;"a;b";2.5\n2;c\n')
    rows = formats.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("1", "a;b", "2.5"), ("2", "c", "")]
    assert formats.sniff_delimiter("a\tb,c\td") == "\t" and formats.sniff_delimiter("abc") == ","


def test_coercion_policies(spark):
    df = spark.createDataFrame([("1", "x"), ("z", "y")], "n string, s string")
    assert [r.n for r in formats.coerce(df, {"n": "long"}).collect()] == [1, None]
    assert [r.n for r in formats.coerce(df, {"n": "long"}, "drop").collect()] == [1]
    with pytest.raises(ValueError):
        formats.coerce(df, {"n": "long"}, "reject")


def test_paths_envelopes_fix(spark):
    df = spark.createDataFrame([('{"items":[{"a":{"b":1}},{"a":{}}]}',)], "j string")
    assert [tuple(r) for r in formats.extract(df, "j", {"b": "$.a.b"}, "$.items[*]").collect()] == [("1",), (None,)]
    with pytest.raises(ValueError):
        formats.extract(df, "j", {"b": "$..b"})
    events = [{"op": "c", "after": {"id": 1, "s": "x"}, "ts_ms": 5}, {"payload": {"op": "d", "before": {"id": 1, "s": "x"}, "ts_ms": 6}}, {"op": "d"}]
    rows = formats.unwrap_cdc(spark.createDataFrame([(json.dumps(e),) for e in events], "j string"), "j", {"id": "long", "s": "string"})
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x", "c", 1, 5), (1, "x", "d", -1, 6)]
    lines = spark.createDataFrame([("8=FIX|35=D|55=AAPL",), ("no",), (None,)], "value string")
    assert [tuple(r) for r in formats.read_fix(lines, {"35": "kind", "55": "symbol", "9": "none"}).collect()] == [("D", "AAPL", None)]
    assert formats.infer_kind([1, 2.5]) == "double" and formats.infer_kind([]) == "string" and formats.infer_kind(["2024-01-01T00:00:00Z"]) == "timestamp"


def test_admission():
    assert ingest.decide("reject", 9, 2, 10).rejected and ingest.decide("block", 9, 2, 10).wait
    assert ingest.decide("drop_newest", 9, 3, 10) == ingest.Decision(1, dropped=2)
    assert ingest.decide("drop_oldest", 9, 3, 10) == ingest.Decision(3, evict=2)
    assert ingest.decide("inline", 99, 3, 10).accept == 3


def test_accepted_and_rejected_rows(spark):
    df = spark.createDataFrame([("1", None, "e"), ("z", 5, "e"), ("3", 9, "e")], "n string, _ts long, extra string")
    good, bad = ingest.accept(df, "src", {"n": "long"}, now=7)
    assert sorted((r.n, r._ts, r._source) for r in good.collect()) == [(1, 7, "src"), (3, 9, "src")]
    assert [r.n for r in bad.collect()] == ["z"]


def test_upsert_keeps_the_last_delta_per_key(spark):
    d = spark.createDataFrame([("a", 1, 1, 1), ("a", 1, -1, 2), ("b", 2, -1, 3), ("b", 3, 1, 4), (None, 9, 1, 5)], "k string, v long, _weight long, _seq long")
    writes, deletes = sinks.upsert_plan(d, ["k"])
    assert [tuple(r) for r in writes.collect()] == [("b", 3)] and [tuple(r) for r in deletes.collect()] == [("a",)]
    old = spark.createDataFrame([("a", 0), ("c", 7)], "k string, v long")
    assert sorted(tuple(r) for r in sinks.merge_into(spark, old, d, ["k"]).collect()) == [("b", 3), ("c", 7)]


def test_step_guard(spark):
    df = spark.createDataFrame([(0,), (3,), (None,)], "_step long")
    assert sorted(r._step for r in sinks.step_guard(df, 3).collect()) == [1, 1]


def test_dedup_keeps_first_arrival(spark):
    df = spark.createDataFrame([("a", 2, 2), ("a", 1, 1), ("b", 5, 3)], "k string, v long, _seq long")
    assert sorted(tuple(r) for r in formats.dedup(df, ["k"]).select("k", "v").collect()) == [("a", 1), ("b", 5)]


def test_generators_are_seeded_and_partition_free(spark):
    from sluice.sources import generators as g

    one = sorted(map(tuple, g.trades(spark, 50).collect()))
    assert one == sorted(map(tuple, g.trades(spark, 50).repartition(3).collect())) and one != sorted(map(tuple, g.trades(spark, 50, seed=2).collect()))
    assert all(r.bid < r.ask for r in g.quotes(spark, 50).collect())
    orders = {}
    for r in sorted(g.lifecycle(spark, 40).collect(), key=lambda r: (r.order_id, r.stage_rank)):
        orders.setdefault(r.order_id, []).append(r)
    for steps in orders.values():
        assert [s.stage for s in steps][:2] == ["NEW", "ACK"] and steps[-1].stage in ("FILLED", "CANCELED")
        assert [s.filled_qty for s in steps] == sorted(s.filled_qty for s in steps)
    rows = g.scenarios(spark, "r", 200, ["a", "b"], 5, rho=1.0).collect()
    assert len(rows) == 2000 and all(abs(r.shock - r.factor) < 1e-12 for r in rows)
    assert all(r.value > 0 for r in g.scenarios(spark, "r", 3, ["a"], 4, kind="lognormal").collect())
    with pytest.raises(ValueError):
        g.scenarios(spark, "r", 10, ["a"], 10, max_rows=99)


@pytest.fixture
def database(spark, tmp_path):
    from sluice.sources import jdbc

    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    jdbc.execute(spark, url, ["CREATE TABLE t (k VARCHAR(20), v BIGINT)", "INSERT INTO t VALUES ('a', 1), ('b', 2), ('c', 3), ('d', 3), ('e', 5)"])
    return url


def test_polled_pages_follow_the_cursor(spark, database):
    from sluice.sources import jdbc

    first = jdbc.poll(spark, database, "V", table="t", page=2)
    assert sorted(r.V for r in first.rows.collect()) == [1, 2] and first.cursor == 2 and first.has_more
    again = jdbc.poll(spark, database, "V", first.cursor, table="t", page=10, inclusive=True)
    assert sorted(r.V for r in again.rows.collect()) == [2, 3, 3, 5] and not again.has_more
    done = jdbc.poll(spark, database, "V", 5, table="t", page=2)
    assert done.rows.count() == 0 and done.cursor == 5 and not done.has_more
    own = jdbc.poll(spark, database, "V", 2, query="SELECT k, v FROM t WHERE v > @cursor AND k <> 'd'")
    assert sorted(r.K for r in own.rows.collect()) == ["c", "e"]
    with pytest.raises(ValueError):
        jdbc.poll(spark, database, "v; DROP TABLE t", table="t")


def test_scans_in_ranges_and_appends(spark, database):
    from sluice.sources import jdbc

    whole = jdbc.scan(spark, database, "t", "V", 3)
    assert whole.rdd.getNumPartitions() == 3 and sorted(r.K for r in whole.collect()) == list("abcde")
    jdbc.append(spark.createDataFrame([("z", 9)], "K string, V long"), database, "t")
    assert jdbc.scan(spark, database, "t").count() == 6


def test_upserts_into_a_database(spark, database):
    from sluice.sources import jdbc

    d = spark.createDataFrame([("a", 7, 1, 1), ("b", 2, -1, 2), ("c", 4, -1, 3), ("c", 8, 1, 4), (None, 9, 1, 5), ("n", 1, 1, 6)], "k string, v long, _weight long, _seq long")
    jdbc.upsert(d, database, "t", ["k"])
    assert sorted(map(tuple, jdbc.scan(spark, database, "t").collect())) == [("a", 7), ("c", 8), ("d", 3), ("e", 5), ("n", 1)]


def test_repeating_groups_nest():
    nested = formats.parse_fix("8=FIX.4.4|35=X|268=2|269=0|270=1.5|453=1|448=p|447=D|269=1|270=2|55=A|10=000|")
    assert nested["MDEntries"] == [{"269": "0", "270": "1.5", "PartyIDs": [{"448": "p", "447": "D", "269": "1", "270": "2", "55": "A"}]}] and nested["10"] == "000"
    bound = formats.parse_fix("8=FIX.4.4|35=X|268=2|269=0|453=2|448=p|447=D|448=q|447=E|269=1|447=z|55=A|10=000|")
    assert bound["MDEntries"] == [{"269": "0", "PartyIDs": [{"448": "p", "447": "D"}, {"448": "q", "447": "E"}]}, {"269": "1"}] and bound["447"] == "z"
    flat = formats.parse_fix("8=F|35=D|555=2|600=a|601=1|600=b|55=A|58=x|58=y")
    assert flat["Legs"] == [{"600": "a", "601": "1"}, {"600": "b"}] and flat["55"] == "A" and flat["58"] == "y"
    one = formats.parse_fix("8=F^35=D^73=1^11=o^10=1")
    assert one["Orders"] == [{"11": "o"}] and one["10"] == "1"
    assert formats.parse_fix("8=F|35=D|73=0|11=o")["Orders"] == [] and formats.parse_fix("8=F|35=D|73=x|11=o")["73"] == "x"
    assert formats.parse_fix("8=F|35=D|73=5|11=a|11=b")["Orders"] == [{"11": "a"}, {"11": "b"}]


def test_raw_data_may_hold_delimiters():
    assert formats.parse_fix("8=F|35=B|95=5|96=a|b=c|10=1") == {"8": "F", "35": "B", "95": "5", "96": "a|b=c", "10": "1"}
    assert formats.parse_fix("8=F|35=B|95=5|58=t") == {"8": "F", "35": "B", "95": "5", "58": "t"}
    assert formats.parse_fix("8=F|35=B||58=a=b|") == {"8": "F", "35": "B", "58": "a=b"}
    assert formats.parse_fix("8=F|35=B|x=1") is None and formats.parse_fix("8=F|55=A") is None and formats.parse_fix("") is None


def test_logs_hold_several_messages_a_line(spark):
    lines = spark.createDataFrame([("12:00 IN\r8=F|35=D|55=A|10=1|8=F|35=8|55=B|73=1|11=o|10=2",), ("",)], "value string")
    rows = formats.read_fix(lines, {"35": "kind", "55": "symbol", "Orders": "orders"}).collect()
    assert [tuple(r) for r in rows] == [("D", "A", None), ("8", "B", '[{"11": "o"}]')]


def test_shards_own_their_keys(spark, tmp_path):
    df = spark.createDataFrame([(i % 7 if i % 5 else None, i) for i in range(100)], "k long, v long")
    sinks.write_sharded(df, f"{tmp_path}/s", ["k"], 4)
    for k in (3, None):
        got = sinks.read_shard(spark, f"{tmp_path}/s", {"k": k}, 4)
        assert sorted(r.v for r in got.collect()) == [i for i in range(100) if (i % 7 if i % 5 else None) == k]
    assert "PartitionFilters: [isnotnull(_shard" in sinks.read_shard(spark, f"{tmp_path}/s", {"k": 3}, 4)._jdf.queryExecution().toString()


@pytest.fixture
def server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        posted, failures = [], [1]

        def do_GET(self):
            body = {"/array": b'[{"a": 1}, {"a": 2}]', "/lines": b'{"a": 3}\n\n{"a": 4}\n'}.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def do_POST(self):
            data = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            fail = bool(self.failures) and self.failures.pop()
            if not fail:
                self.posted.append([e["v"] for e in data["events"]])
            self.send_response(503 if fail else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", Handler
    s.shutdown()


def test_http_source_and_sink(spark, server):
    from sluice.sources import http

    at, handler = server
    got = http.fetch(spark, [f"{at}/array", f"{at}/lines", f"{at}/none"])
    assert sorted(json.loads(r.j)["a"] for r in http.items(got).collect()) == [1, 2, 3, 4]
    assert [r.error for r in got.filter("value is null").collect()] == ["HTTPError: HTTP Error 404: Not Found"]
    assert "ValueError" in http.fetch(spark, [f"{at}/array"], largest=3).first().error
    sent = http.post(spark.range(5).withColumnRenamed("id", "v").coalesce(1), at, batch=2, wait=0.01).collect()
    assert [tuple(r) for r in sent] == [(5, 0)] and sorted(sum(handler.posted, [])) == list(range(5)) and len(handler.posted) == 3
    handler.failures.extend([1, 1])
    assert [tuple(r) for r in http.post(spark.range(1), at, tries=2, wait=0.01).filter("sent + failed > 0").collect()] == [(0, 1)]
