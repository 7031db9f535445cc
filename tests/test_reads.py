import json

import pytest
from pyspark.sql import functions as F

from sluice.operators import reads
from sluice.operators.reads import Reader
from sluice.plans.engine import Engine
from sluice.sources.poll import Inbox, KeyWindow, Ledger, Poller, Schedule


def test_pages_and_exports(spark, tmp_path):
    rows = spark.range(250).select((F.col("id") * 7 % 250).alias("k"), F.when(F.col("id") > 3, F.col("id")).alias("v"))
    assert [r.k for r in reads.page(rows, ["k"], 3, 5).collect()] == [5, 6, 7]
    assert reads.page(rows, ["k"]).count() == 100 and reads.page(rows, ["k"], 10, 245).count() == 5
    with pytest.raises(ValueError):
        reads.page(rows, ["k"], -1)
    reads.export_csv(rows, f"{tmp_path}/out", ["k"], limit=0, offset=2)
    text = next(tmp_path.glob("out/*.csv")).read_text()
    assert text == "k,v\n2,36\n"


def R(**row):
    return row


@pytest.mark.parametrize(
    "keys, page, buffered, live, want",
    [
        (["id"], [(R(id=1, v=1), 1), (R(id=2, v=5), 0)], [], [[(R(id=3, v=2), 1)]], [R(id=1, v=1), R(id=3, v=2)]),
        (["id"], [(R(id=1, v=1), 1)], [], [[(R(id=1, v=1), -1), (R(id=1, v=2), 1)]], [R(id=1, v=2)]),
        (["id"], [(R(id=1, v=1), 1)], [], [[(R(id=1, v=2), 1)], [(R(id=1, v=1), -1)]], [R(id=1, v=2)]),
        (["id"], [(R(id=1, v=2), 1)], [[(R(id=1, v=1), -1), (R(id=1, v=9), 1)]], [], [R(id=1, v=2)]),
        (["id"], [(R(id=1, v=1), 1)], [[(R(id=1, v=1), -1), (R(id=1, v=9), 1)]], [], [R(id=1, v=9)]),
        (["id"], [], [[(R(id=4, v=1), 1)]], [], [R(id=4, v=1)]),
        (["id"], [(R(id=1, v=1), 1), (R(id=1, v=3), 1)], [], [], [R(id=1, v=3)]),
        (["a", "b"], [], [], [[(R(a=1, b=1, v=1), 1), (R(a=1, b=2, v=1), 1), (R(a=1, b=2, v=7), 1)]], [R(a=1, b=1, v=1), R(a=1, b=2, v=7)]),
        ([], [(R(n=4), 1)], [], [[(R(n=5), 1)], [(R(n=4), -1)]], [R(n=5)]),
        (None, [(R(v=1), 1)], [], [[(R(v=2), 2)], [(R(v=1), -2), (R(v=2), -1)]], [R(v=2)]),
    ],
)
def test_readers_hold_what_the_table_has(keys, page, buffered, live, want):
    reader = Reader(keys).catch_up(page, buffered)
    for batch in live:
        reader.apply(batch)
    assert sorted(map(repr, reader.rows())) == sorted(map(repr, want))


def test_a_reader_follows_a_maintained_view(spark):
    schema = "k string, v long, _ts long, _seq long, _weight long"
    view = Engine(spark).register("t", spark.createDataFrame([], schema)).maintain("SELECT k, SUM(v) AS s FROM t GROUP BY k")
    reader = Reader(["k"])
    for rows in ([("a", 1, 0, 1, 1), ("b", 2, 0, 2, 1)], [("a", 4, 0, 3, 1), ("b", 2, 0, 4, -1)]):
        changes = view.apply({"t": spark.createDataFrame(rows, schema)}).collect()
        reader.apply(({"k": r.k, "s": r.s}, r["_weight"]) for r in changes)
    assert reader.rows() == [{"k": "a", "s": 5}]


def test_poll_cycles_read_what_is_new(spark, tmp_path):
    src, at = tmp_path / "src", f"file://{tmp_path}/land"
    src.mkdir()
    (src / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": 2, "v": "y"}\n')
    (src / "b.json").write_text("not json")
    (src / "c.txt").write_text("skipped")
    p = Poller(spark, at, {"id": "long", "v": "string"}, key="id")
    total, errors = p.poll(str(src), 5, "*.json")
    assert total == 2 and len(errors) == 1 and errors[0].startswith("b.json")
    assert p.poll(f"{tmp_path}/none", 5) == (0, [f"not found: {tmp_path}/none"])
    (src / "b.json").write_text('{"id": 2, "v": "again"}\n{"id": 3, "v": "z"}\n{"v": "no id"}\n')
    assert p.poll(str(src), 6, "*.json") == (2, []) and p.poll(str(src), 7, "*.json") == (0, [])
    got = [tuple(r) for r in spark.read.parquet(f"{at}/rows").orderBy("_seq").collect()]
    assert [(r[0], r[1], r[2]) for r in got] == [(1, "x", 5), (2, "y", 5), (3, "z", 6), (None, "no id", 6)]
    q = p.stream().writeStream.format("parquet").option("path", f"{at}/copy").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{at}/copy").count() == 4


def test_documents_are_mapped(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"a": {"id": "7"}}, {"a": {"id": "bad"}}]}))
    p = Poller(spark, f"file://{tmp_path}/land", {"id": "long"}, "json_array", {"id": "$.a.id"}, "$.data[*]", policy="drop")
    assert p.poll(str(tmp_path / "d.json"), 1) == (1, [])


def test_ledgers_windows_and_schedules(spark):
    ledger = Ledger(limit=2)
    for name in "abc":
        ledger.record(name, 1)
    assert ledger.is_new("a", 1) and not ledger.is_new("c", 1) and ledger.is_new("c", 2)
    window, rows = KeyWindow(limit=2), lambda *ks: spark.createDataFrame([(k, n) for n, k in enumerate(ks)], "k string, _seq long")
    assert sorted(r.k for r in window.fresh(rows("a", "b", "a"), "k").collect()) == ["a", "b"]
    assert [r.k for r in window.fresh(rows("b", "c"), "k").collect()] == ["c"] and list(window.keys) == ["b", "c"]
    s = Schedule(2_000)
    assert [s.after(f) for f in (False, True, True, False)] == [2_000, 4_000, 8_000, 2_000]
    with pytest.raises(ValueError):
        Schedule(10)


def test_requests_come_once(spark, tmp_path):
    inbox = Inbox(spark, f"file://{tmp_path}/in", "push", {"n": "long"})
    rows = spark.createDataFrame([("1",), ("x",)], "n string")
    assert inbox.push(rows, 3, "k1") == {"accepted": 1, "rejected": 1, "replayed": False}
    assert inbox.push(rows, 4, "k1")["replayed"] and spark.read.parquet(f"{tmp_path}/in/rows").count() == 1
