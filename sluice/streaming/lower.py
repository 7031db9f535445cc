"""Pipeline statements on Structured Streaming.

The same statement that ``Engine`` replays is lowered to a streaming plan: projections and filters as they
are, windows to stateful aggregates that give a row when the watermark passes their end, ``WITHIN`` joins to stream-stream joins whose state a
range of event times bounds.  A join below a window is a query of its own, whose output the window reads as a stream.

Results go to Parquet through the file sink, exactly once; nothing is gathered on the driver.  ``end`` closes what is still open:
a row from the end of time comes in beside the source and carries the watermark past everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.watermark import LATENESS
from ..plans import engine as E
from ..sql.ast import Agg, Col, Item, Select, Source, SqlError, Union
from ..sql.parser import parse, split_sink
from ..storage import fresh_path

#: Later than any event: the year 5138.
END_OF_TIME = 100_000_000_000_000


class StreamEngine:
    """Streams by name, and the queries over them.  ``run`` reads what is there; it can be called again for more."""

    def __init__(self, spark: SparkSession, path: str | None = None, lateness: int = LATENESS):
        self.spark, self.lateness, self.path = spark, lateness, path or fresh_path(spark, "streams")
        self.engine = E.Engine(spark, "pipeline", lateness=None)
        self.streams: dict[str, tuple] = {}

    def register(self, name: str, stream: DataFrame, json: tuple[str, ...] = ()) -> "StreamEngine":
        """A streaming frame with ``_ts`` and ``_seq``."""
        if not stream.isStreaming:
            raise ValueError(f"{name} is not a stream")
        self.engine.register(name, self._marked(name, stream), json)
        return self

    def _marked(self, name: str, stream: DataFrame) -> DataFrame:
        """The stream with event time and watermark, and with the row that ends it, once there is one."""
        at = f"{self.path}/end-{name}"
        self.spark.createDataFrame([], stream.schema).write.mode("append").parquet(at)
        self.streams[name] = (at, stream.schema)
        both = stream.unionByName(self.spark.readStream.schema(stream.schema).parquet(at))
        timed = both.withColumn(E.TIME, F.timestamp_millis("_ts"))
        return timed.withWatermark(E.TIME, f"{self.lateness} milliseconds")

    def end(self) -> None:
        """Lets the next ``run`` close all windows and pad all unmatched rows."""
        # No value is null: filters that Spark infers from joins are applied before the watermark sees a row.
        plain = {"string": "", "boolean": False, "binary": b""}
        for at, schema in self.streams.values():
            kinds = {f.name: f.dataType for f in schema}
            last = [F.lit(END_OF_TIME if n == "_ts" else plain.get(t.simpleString(), 0)).cast(t).alias(n) for n, t in kinds.items()]
            self.spark.range(1).select(*last).write.mode("append").parquet(at)

    def plan(self, sql: str) -> DataFrame:
        """The streaming frame of a statement without a join below a window."""
        return self._shown(parse(split_sink(sql)[1]))

    def _shown(self, statement) -> DataFrame:
        found = self.engine.lower(statement)
        bounds = [c for c in ("window_start", "window_end") if c in found.df.columns and c not in found.kinds]
        return found.df.filter(F.col("_ts") < END_OF_TIME).select(*[f"`{c}`" for c in found.kinds], *bounds, "_ts", "_seq")

    def run(self, sql: str, name: str, end: bool = True) -> DataFrame:
        """Runs the statement over what its streams hold and gives all rows of its result so far.

        ``name`` tells the query's state and result apart.  ``end``: the streams end here."""
        statement = parse(split_sink(sql)[1])
        if end:
            self._drain(statement, name)
            self.end()
        self._drain(statement, name)
        schema = self._schema(statement, name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/rows").drop("_ts", "_seq")

    def _schema(self, statement, name: str):
        return self._shown(self._staged(statement, name, run=False)).schema

    def _drain(self, statement, name: str) -> None:
        self._write(self._shown(self._staged(statement, name, run=True)), name)

    def _write(self, rows: DataFrame, name: str) -> None:
        writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{self.path}/{name}/rows")
        query = writer.option("checkpointLocation", f"{self.path}/{name}/log").trigger(availableNow=True).start()
        query.awaitTermination()

    def _staged(self, q, name: str, run: bool):
        """The statement with joins and windows below a window replaced by streams of their results."""
        if isinstance(q, Union):
            return Union([self._staged(b, f"{name}-{k}", run) for k, b in enumerate(q.branches)], q.all)
        if not q.window:
            return q
        if q.source.query is not None and not q.joins:
            inner = self._staged(q.source.query, f"{name}-in", run)
            view = self._view(inner, f"{name}-in", run)
            return Select(q.items, Source(q.source.alias, name=view), [], q.where, q.group_by, q.group_all, None, q.window, q.emit_changes)
        if not any(j.kind != "unnest" for j in q.joins):
            return q
        return self._split(q, name, run)

    def _split(self, q: Select, name: str, run: bool) -> Select:
        from ..plans.maintain import flat, rewritten

        w = self.engine.scan(q.source)
        for j in q.joins:
            w = self.engine.join(w, j)
        shown = [Item(Col(f, a), flat(a, f)) for a, f in w.fields if f != "_ts"]
        view = self._view(Select(shown, q.source, q.joins, q.where), f"{name}-join", run)

        def place(c: Col) -> Col:
            own = [(a, f) for a, f in w.fields if f.lower() == c.name.lower() and c.alias in (None, a)]
            if not own:
                raise SqlError(f"Unknown column '{c.name}'", *c.at)
            return Col(flat(*own[0]), "_d", c.at)

        items = [Item(rewritten(i.expr, place), i.alias or E.default_name(i.expr, k)) for k, i in enumerate(q.items)]
        group = [rewritten(i.expr, place) for i in q.items if not any(isinstance(n, Agg) for n in E.walk(i.expr))] if q.group_all else [rewritten(g, place) for g in q.group_by or ()]
        return Select(items, Source("_d", name=view), [], None, group or None, False, None, q.window, q.emit_changes)

    def _view(self, inner, name: str, run: bool) -> str:
        """A relation over the stored results of a statement, read as a stream."""
        rows = self._shown(inner)
        if run:
            self._write(rows, name)
        names = list(self.engine.lower(inner).kinds)
        kinds = tuple(c for c, k in self.engine.lower(inner).kinds.items() if k == "json")
        stream = self.spark.readStream.schema(rows.schema).parquet(f"{self.path}/{name}/rows")
        if name not in self.streams:
            self.register(name, stream.select(*[f"`{c}`" for c in names], "_ts", "_seq"), kinds)
        return name


