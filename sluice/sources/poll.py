"""Poll cycles: what a URL, a file or a folder has that was not seen before, landed for streams to read.

A cycle lists names and times of change, reads what is new with Spark, maps and coerces it, leaves out keys that a window
of recent keys holds, and appends the rest to a landing folder of Parquet, which ``readStream`` follows.  A document
that can't be read is reported and tried again; the others still land."""

from __future__ import annotations

import fnmatch
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats, http

#: Documents that a ledger remembers, and keys that a window does.
REMEMBERED = 10_000
WINDOW = 10_000
LEAST_INTERVAL = 1_000
LONGEST_WAIT = 300_000


@dataclass
class Ledger:
    """The time of change of each document when it was last read; the oldest entries go first."""

    limit: int = REMEMBERED
    seen: OrderedDict[str, int] = field(default_factory=OrderedDict)

    def is_new(self, name: str, changed: int) -> bool:
        return self.seen.get(name) != changed

    def record(self, name: str, changed: int) -> None:
        self.seen.pop(name, None)
        self.seen[name] = changed
        while len(self.seen) > self.limit:
            self.seen.popitem(last=False)


@dataclass
class KeyWindow:
    """The latest keys, first in first out: a key that is in the window is not new."""

    limit: int = WINDOW
    keys: OrderedDict[str, None] = field(default_factory=OrderedDict)

    def fresh(self, rows: DataFrame, column: str) -> DataFrame:
        """The first row of each key that the window doesn't hold; null keys are always new.  The window moves on by at most its size."""
        spark = rows.sparkSession
        known = spark.createDataFrame([(k,) for k in self.keys], "_key string")
        keyed = rows.withColumn("_key", F.col(column).cast("string"))
        new = keyed.filter("_key is not null").join(F.broadcast(known), "_key", "left_anti")  # at most WINDOW short rows
        first = new.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), "_seq").alias("r"), F.min("_seq").alias("_at"))
        for r in first.orderBy(F.desc("_at")).limit(self.limit).orderBy("_at").select("_key").collect():
            self.keys[r["_key"]] = None
        while len(self.keys) > self.limit:
            self.keys.popitem(last=False)
        return first.select("r.*").unionByName(keyed.filter("_key is null").drop("_key"))


@dataclass
class Schedule:
    """A fixed interval; after failures in a row the wait doubles each time, up to a limit."""

    every: int
    failures: int = 0

    def __post_init__(self):
        if self.every < LEAST_INTERVAL:
            raise ValueError(f"the interval is {LEAST_INTERVAL} ms at least")

    def after(self, failed: bool) -> int:
        """Milliseconds until the next cycle."""
        self.failures = self.failures + 1 if failed else 0
        return self.every if not self.failures else min(max(LONGEST_WAIT, self.every), self.every * 2 ** min(self.failures, 30))


def listed(spark: SparkSession, path: str, glob: str = "*") -> list[tuple[str, int]]:
    """Names and times of change in a folder, or of a file, in the order of names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    found = [(s.getPath(), s.getModificationTime()) for s in fs.listStatus(at) if s.isFile()]
    return sorted((p.toString(), t) for p, t in found if fnmatch.fnmatch(p.getName(), glob))


class Poller:
    """A polled source.  ``read``: from a document's path to rows; ``fields``: declared kinds; ``key``: the column of the window."""

    def __init__(
        self, spark: SparkSession, landing: str, fields: dict[str, str], kind: str = "json", mapping: dict[str, str] | None = None, items: str = "$",
        policy: str = "null", key: str | None = None, read: Callable[[str], DataFrame] | None = None,
    ):
        self.spark, self.landing, self.fields, self.kind, self.policy, self.key = spark, landing, fields, kind, policy, key
        self.mapping, self.items, self.read = mapping, items, read or self._read
        self.ledger, self.window, self.next = Ledger(), KeyWindow(), 0

    def _read(self, path: str) -> DataFrame:
        if self.mapping is not None:
            whole = self.kind == "json_array"
            text = self.spark.read.text(path, wholetext=whole).withColumnRenamed("value", "j")
            return formats.extract(text, "j", self.mapping, self.items)
        if self.kind == "csv":
            return formats.read_csv(self.spark, path)
        declared = ", ".join(f"`{c}` string" for c in self.fields)
        reader = self.spark.read.schema(declared).option("mode", "FAILFAST").option("multiLine", self.kind == "json_array")
        return reader.json(path)

    def poll(self, path: str, now: int, glob: str = "*") -> tuple[int, list[str]]:
        """A file or folder: each document that is new or changed.  Gives the rows landed, and errors."""
        errors, total = [], 0
        try:
            documents = listed(self.spark, path, glob)
        except FileNotFoundError:
            return 0, [f"not found: {path}"]
        for name, changed in documents:
            if not self.ledger.is_new(name, changed):
                continue
            try:
                total += self._land(self.read(name), now)
                self.ledger.record(name, changed)
            except (PySparkException, Py4JJavaError, ValueError) as problem:
                errors.append(f"{name.rsplit('/', 1)[-1]}: {str(problem).splitlines()[0]}")
        return total, errors

    def fetch(self, urls: list[str], now: int, **options) -> tuple[int, list[str]]:
        """URLs: the items of their documents, each cycle anew; the window keeps out what was seen."""
        got = http.fetch(self.spark, urls, **options).checkpoint()
        errors = [f"{r['url']}: {r['error']}" for r in got.filter("error is not null").select("url", "error").collect()]
        mapping = self.mapping or {c: f"$.{c}" for c in self.fields}
        return self._land(formats.extract(http.items(got), "j", mapping), now), errors

    def _land(self, rows: DataFrame, now: int) -> int:
        typed = formats.coerce(rows, self.fields, self.policy).select(*[f"`{c}`" for c in self.fields])
        # Arrival numbers go on from document to document; within one they are those of its rows.
        seq = F.monotonically_increasing_id() + F.lit(self.next).cast("bigint")
        stamped = typed.withColumn("_ts", F.lit(now).cast("bigint")).withColumn("_seq", seq).checkpoint()
        last = stamped.agg(F.max("_seq")).first()[0]
        new = (self.window.fresh(stamped, self.key) if self.key else stamped).checkpoint()
        new.write.mode("append").parquet(f"{self.landing}/rows")
        self.next = self.next if last is None else last + 1
        return new.count()

    def stream(self) -> DataFrame:
        """The landed rows as a stream."""
        kinds = {"long": "bigint", "double": "double", "bool": "boolean", "timestamp": "bigint", "string": "string"}
        schema = ", ".join(f"`{c}` {kinds[k]}" for c, k in self.fields.items()) + ", _ts bigint, _seq bigint"
        return self.spark.readStream.schema(schema).parquet(f"{self.landing}/rows")


class Inbox:
    """Pushed rows: accepted ones land, and a request that comes again under its key is answered as it was the first time."""

    LIMIT = 1_000

    def __init__(self, spark: SparkSession, landing: str, source: str, declared: dict[str, str]):
        self.spark, self.landing, self.source, self.declared = spark, landing, source, declared
        self.answers: OrderedDict[str, dict] = OrderedDict()

    def push(self, rows: DataFrame, now: int, key: str | None = None) -> dict:
        from .ingest import accept

        if key is not None and key in self.answers:
            return self.answers[key] | {"replayed": True}
        good, bad = accept(rows, self.source, self.declared, now)
        good, rejected = good.checkpoint(), bad.count()
        good.write.mode("append").parquet(f"{self.landing}/rows")
        answer = {"accepted": good.count(), "rejected": rejected, "replayed": False}
        if key is not None:
            self.answers[key] = answer
            while len(self.answers) > self.LIMIT:
                self.answers.popitem(last=False)
        return answer
