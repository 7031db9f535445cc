import pytest

from sluice.plans.engine import Engine
from sluice.streaming.lower import StreamEngine

SCHEMA = "k string, v long, _ts long, _seq long"
DAY = 86_400_000
A = [("a", 1, 0, 1), ("b", 2, 4_000, 2), ("a", 3, 9_000, 3), ("a", 4, 21_000, 5), (None, 5, 22_000, 6), ("b", 7, 61_000, 8)]
B = [("a", 10, 1_000, 1), ("b", 20, 30_000, 4), ("c", 30, 60_500, 7), ("a", 40, 62_000, 9)]
A, B = ([(k, v, ts + DAY, seq) for k, v, ts, seq in rows] for rows in (A, B))

STATEMENTS = [
    "SELECT k, v + 1 AS w FROM a WHERE v > 1",
    "SELECT k, COUNT(*) AS n, SUM(v) AS s, COUNT(DISTINCT v) AS d FROM a GROUP BY k WINDOW TUMBLING(SIZE 10 SECONDS)",
    "SELECT k, COUNT(*) AS n FROM a WHERE k = 'a' GROUP BY ALL WINDOW TUMBLING(SIZE 10 SECONDS)",
    "SELECT COUNT(*) AS n, MAX(v) AS hi FROM a WINDOW HOPPING(SIZE 10 SECONDS, ADVANCE BY 4 SECONDS)",
    "SELECT COUNT(*) AS n FROM a WINDOW HOPPING(SIZE 4 SECONDS, ADVANCE BY 10 SECONDS)",
    "SELECT k, COUNT(*) AS n FROM a GROUP BY k WINDOW SESSION(GAP 5 SECONDS)",
    "SELECT COUNT(*) AS n, AVG(v) AS m FROM a WINDOW SESSION(GAP 12 SECONDS)",
    "SELECT x.k AS k, x.v AS v, y.v AS w FROM a x JOIN b y WITHIN 10 SECONDS ON x.k = y.k",
    "SELECT x.k AS k, x.v AS v, y.v AS w FROM a x LEFT JOIN b y WITHIN 10 SECONDS ON x.k = y.k",
    "SELECT x.k AS k, y.k AS l, y.v AS w FROM a x RIGHT JOIN b y WITHIN 3 SECONDS ON x.k = y.k",
    "SELECT x.k AS k, x.v AS v, y.k AS l, y.v AS w FROM a x FULL JOIN b y WITHIN 3 SECONDS ON x.k = y.k",
    "SELECT x.k, COUNT(*) AS n FROM a x JOIN b y WITHIN 20 SECONDS ON x.k = y.k GROUP BY x.k WINDOW TUMBLING(SIZE 30 SECONDS)",
    "SELECT MAX(n) AS peak FROM (SELECT k, COUNT(*) AS n FROM a GROUP BY k WINDOW TUMBLING(SIZE 10 SECONDS)) h WINDOW TUMBLING(SIZE 60 SECONDS)",
    "SELECT k, v FROM a UNION ALL SELECT k, v FROM b",
]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These tables are small: a task each is enough, and compiling plans takes longer than running them."""
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")


def bag(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def stream(spark, rows, path):
    """Files of two rows, in the order of arrival."""
    for k in range(0, len(rows), 2):
        spark.createDataFrame(rows[k : k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def feeds(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("feeds")
    return lambda: (stream(spark, A, f"{root}/a") if not (root / "a").exists() else spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/a"),
                    stream(spark, B, f"{root}/b") if not (root / "b").exists() else spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/b"))


@pytest.mark.parametrize("number", range(len(STATEMENTS)))
def test_streams_equal_their_replay(spark, feeds, tmp_path, number):
    a, b = feeds()
    streams = StreamEngine(spark, f"file://{tmp_path}/s").register("a", a).register("b", b)
    replay = Engine(spark, "pipeline", lateness=None).register("a", spark.createDataFrame(A, SCHEMA)).register("b", spark.createDataFrame(B, SCHEMA))
    assert bag(streams.run(STATEMENTS[number], "q")) == bag(replay.query(STATEMENTS[number]))


def test_open_windows_wait_for_the_end(spark, feeds, tmp_path):
    a, b = feeds()
    streams = StreamEngine(spark, f"file://{tmp_path}/s").register("a", a)
    sql = "SELECT COUNT(*) AS n FROM a WINDOW TUMBLING(SIZE 10 SECONDS)"
    assert bag(streams.run(sql, "q", end=False)) == [(2, DAY + 30_000, DAY + 20_000), (3, DAY + 10_000, DAY)]
    assert len(bag(streams.run(sql, "q"))) == 3
    with pytest.raises(ValueError):
        streams.register("c", spark.createDataFrame(A, SCHEMA))
