"""Statements to DataFrames.

An engine holds named relations and lowers a statement in one of two modes.
*Pipeline* mode replays append-only sources: windows, ``WITHIN`` joins, late rows
dropped by one watermark over all sources of a statement.  *Table* mode gives the snapshot of a maintained view: running aggregates,
equi-joins, ``LATEST BY``.  Everything becomes one declarative plan; Catalyst
pushes filters and prunes columns below the joins.

Every relation has ``_ts`` (epoch milliseconds), ``_source`` and ``_seq`` (arrival)."""

from __future__ import annotations

from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import builtins as B
from ..functions import quant
from ..functions.builtins import SPARK, Typed
from ..functions.registry import Registry
from ..operators import zset
from ..operators.watermark import LATENESS, drop_late_together
from ..sources.sinks import Sink
from ..sql.ast import Agg, Bin, Cast, Col, Exists, Fn, If, InQuery, Item, Join, Lit, Path, Scalar, Select, SqlError, Star, Un, Union
from ..sql.parser import parse, references, sources, split_sink

META = ("_ts", "_source", "_seq")
#: The event time of a stream's rows, with its watermark.
TIME = "_time"
#: The clock of a relation that doesn't say in which order its rows arrived.
UNORDERED = "unordered"
KINDS = {"string": "string", "bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double", "boolean": "bool"}


@dataclass
class Relation:
    df: DataFrame
    kinds: dict[str, str]
    #: The log whose arrival order is the order of event time, if the relation comes from one: no row of it is late.
    clock: str | None = None
    view: bool = False


@dataclass
class Working:
    """A joined row: columns by alias and field."""

    df: DataFrame
    fields: dict[tuple[str, str], tuple[str, str]]  # (alias, field) -> column, kind
    aliases: list[str]

    def find(self, col: Col) -> Typed | None:
        hits = [v for (a, f), v in self.fields.items() if f.lower() == col.name.lower() and (col.alias is None or a == col.alias)]
        if len(hits) > 1:
            raise SqlError(f"Ambiguous column '{col.name}'", *col.at)
        return Typed(F.col(f"`{hits[0][0]}`"), hits[0][1]) if hits else None


def walk(x):
    """All nodes of an expression, subqueries left out."""
    yield x
    if isinstance(x, (tuple, list)):
        for y in x:
            yield from walk(y)
    elif isinstance(x, (Un, Bin, Path, Fn, Agg, Cast, If, InQuery)):
        for k in x.__dataclass_fields__:
            if k not in ("query", "at"):
                yield from walk(getattr(x, k))


def conjuncts(x) -> list:
    return [] if x is None else [*conjuncts(x.left), *conjuncts(x.right)] if isinstance(x, Bin) and x.op == "AND" else [x]


def default_name(expr, k: int) -> str:
    if isinstance(expr, Agg):
        return "count_star" if expr.arg is None else expr.name
    if isinstance(expr, Col):
        return expr.name
    if isinstance(expr, Fn):
        return expr.name.lower()
    if isinstance(expr, Path) and isinstance(expr.step, str):
        return expr.step
    return f"col{k}"


class Engine:
    def __init__(self, spark: SparkSession, mode: str = "table", lateness: int | None = LATENESS):
        """``lateness``: allowed in a pipeline, in milliseconds; None keeps late rows."""
        self.spark, self.mode, self.lateness = spark, mode, lateness
        self.relations: dict[str, Relation] = {}
        self.sinks: dict[str, Sink] = {}
        self.registry = quant.install(Registry())
        self._admitted: dict[str, DataFrame] = {}

    # Catalog

    def register(self, name: str, df: DataFrame, json: tuple[str, ...] = (), clock: str | None = None) -> "Engine":
        """A relation.  ``_ts``, ``_source`` and ``_seq`` are filled in where they lack.

        Rows with ``_weight`` or ``_retract`` are changes: in a table the rows that they leave are seen (a
        statement with ``LATEST BY`` sees retractions of keys).  ``clock``: see ``Relation``."""
        changes = [c for c in (zset.W, "_retract", TIME) if c in df.columns]
        kinds = {c: "json" if c in json else KINDS.get(t) for c, t in df.dtypes if c not in (*META, *changes)}
        bad = [c for c, k in kinds.items() if k is None]
        if bad:
            raise ValueError(f"columns of kinds the dialect lacks: {bad}")
        for c, t in df.dtypes:
            if t in ("int", "smallint", "tinyint"):
                df = df.withColumn(c, F.col(c).cast("bigint"))
            elif t == "float":
                df = df.withColumn(c, F.col(c).cast("double"))
        if "_ts" not in df.columns:
            df = df.withColumn("_ts", F.lit(0).cast("bigint"))
        if "_seq" not in df.columns:
            clock = clock or UNORDERED
            df = df.withColumn("_seq", F.lit(0).cast("bigint"))
        if "_source" not in df.columns:
            df = df.withColumn("_source", F.lit(name))
        self.relations[name] = Relation(df, kinds, clock)
        return self

    def sink(self, name: str, sink: "Sink") -> "Engine":
        """What ``INSERT INTO name`` writes to."""
        self.sinks[name] = sink
        return self

    def create(self, name: str, sql: str) -> "Engine":
        """A view over what is registered; views chain."""
        found = self.lower(parse(split_sink(sql)[1]))
        self.relations[name] = Relation(found.df, found.kinds, view=True)
        return self

    def validate(self, sql: str) -> list[SqlError]:
        """Diagnostics with their place; never raises."""
        try:
            sink, text = split_sink(sql)
            self._target(sink)
            found = self.lower(parse(text))
            found.df.schema  # noqa: B018  what only the analyzer finds
        except SqlError as error:
            return [error]
        except RecursionError:
            return [SqlError("The statement is nested too deeply")]
        except PySparkException as error:
            return [SqlError(str(error).splitlines()[0])]
        return []

    def _target(self, name: str | None) -> "Sink | None":
        if name is not None and name not in self.sinks:
            raise SqlError(f"Unknown sink '{name}'")
        return self.sinks[name] if name is not None else None

    def create_all(self, views: dict[str, str]) -> "Engine":
        """Views that may name each other, in an order in which each finds what it names."""
        needs = {name: [r for r in references(split_sink(sql)[1]) if r in views] for name, sql in views.items()}
        try:
            order = list(TopologicalSorter(needs).static_order())
        except CycleError as error:
            raise ValueError(f"views name each other in a circle: {' -> '.join(error.args[1])}") from None
        for name in order:
            self.create(name, views[name])
        return self

    @staticmethod
    def identity(sql: str) -> list[str] | None:
        """The output columns that tell a statement's rows apart: those of its GROUP BY or LATEST BY
        keys.  None stands for the whole row, also where a key isn't projected."""
        statement = parse(split_sink(sql)[1])
        if isinstance(statement, Union):
            return None
        shown = [(i.expr, i.alias or default_name(i.expr, k)) for k, i in enumerate(statement.items) if isinstance(i, Item)]
        every = [x for x, _ in shown if not any(isinstance(n, Agg) for n in walk(x))] if statement.group_all else None
        keys = every or statement.group_by or statement.latest_by
        if not keys:
            return None
        out = [next((name for x, name in shown if x == key), None) for key in keys]
        return None if None in out else out

    def lineage(self, sql: str) -> list[str]:
        return [r for r in references(sql) if r in self.relations]

    def query(self, sql: str, meta: tuple[str, ...] = ()) -> DataFrame:
        """The statement's rows: its columns, window bounds, and ``meta`` columns on demand.

        ``INSERT INTO sink`` writes them to the sink and gives what the sink then holds of them."""
        name, text = split_sink(sql)
        sink = self._target(name)
        found = self.lower(parse(text))
        extra = [c for c in ("window_start", "window_end", "_final") if c in found.df.columns and c not in found.kinds]
        out = found.df.select(*[f"`{c}`" for c in found.kinds], *extra, *meta)
        return out if sink is None else sink.write(out)

    def maintain(self, sql: str, path: str | None = None):
        """The statement as a maintained view over changes of its relations: see ``maintain.Maintained``."""
        from .maintain import Maintained

        return Maintained(self, sql, path)

    def explain(self, sql: str) -> str:
        return self.query(sql)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # Relations

    def lower(self, statement) -> Relation:
        """A whole statement: late rows of its sources go, by one watermark over all of them."""
        self._admitted = self._on_time(statement) if self.mode == "pipeline" and self.lateness is not None else {}
        try:
            return self.relation(statement)
        finally:
            self._admitted = {}

    def _on_time(self, statement) -> dict[str, DataFrame]:
        named = {n: self.relations[n] for n in sources(statement) if n in self.relations}
        named = {n: r for n, r in named.items() if not r.view and r.clock != UNORDERED}
        clocks = {r.clock for r in named.values()}
        if not named or (len(clocks) == 1 and None not in clocks):
            return {}
        return drop_late_together({n: r.df for n, r in named.items()}, self.lateness)

    def relation(self, statement) -> Relation:
        return self.union(statement) if isinstance(statement, Union) else self.select(statement)

    def union(self, u: Union) -> Relation:
        if not u.all and self.mode == "pipeline":
            raise SqlError("UNION without ALL is for tables")
        parts = [self.relation(b) for b in u.branches]
        names = list(parts[0].kinds)
        if any(len(p.kinds) != len(names) for p in parts):
            raise SqlError("UNION branches differ in their number of columns")
        kinds = {}
        for k, name in enumerate(names):
            own = {list(p.kinds.values())[k] for p in parts} - {"null"}
            if len(own) > 1 and not own <= {"long", "double"}:
                raise SqlError(f"UNION column '{name}' has kinds {', '.join(sorted(own))}")
            kinds[name] = "double" if len(own) > 1 else (own or {"null"}).pop()
        label = ",".join(dict.fromkeys(x for b in u.branches for x in (self._labels(b))))
        out = None
        for p in parts:
            cols = [F.col(f"`{c}`").cast(SPARK[kinds[n]]).alias(n) for c, n in zip(p.kinds, names)]
            df = p.df.select(*cols, "_ts", F.lit(label).alias("_source"), "_seq")
            out = df if out is None else out.union(df)
        if not u.all:
            # Event time is part of a row's identity.
            out = out.groupBy(*[f"`{n}`" for n in names], "_ts", "_source").agg(F.min("_seq").alias("_seq"))
        return Relation(out, kinds)

    def _labels(self, b) -> list[str]:
        return [x for c in b.branches for x in self._labels(c)] if isinstance(b, Union) else [b.source.alias, *(j.alias for j in b.joins)]

    def scan(self, source, keyed: bool = False) -> Working:
        """``keyed``: retractions are left to LATEST BY."""
        if source.query is not None:
            rel = self.relation(source.query)
            extra = {c: "long" for c in ("window_start", "window_end") if c in rel.df.columns and c not in rel.kinds}
            rel = Relation(rel.df, rel.kinds | extra)
        elif source.name in self.relations:
            rel = self.relations[source.name]
            rel = Relation(self._admitted.get(source.name, rel.df), rel.kinds)
            if not keyed and self.mode == "table" and {zset.W, "_retract"} & set(rel.df.columns):
                rel = Relation(zset.current(rel.df), rel.kinds)
        else:
            raise SqlError(f"Unknown relation '{source.name}'", *source.at)
        a = source.alias
        # A name in the dialect has no dot, so no two fields share a column.
        fields = {(a, f): (f"{a}.{f}", k) for f, k in rel.kinds.items()}
        cols = [F.col(f"`{f}`").alias(c) for (_, f), (c, _) in fields.items()]
        fields[a, "_ts"] = (f"{a}._ts", "long")
        more = ["_retract"] if keyed and "_retract" in rel.df.columns else []
        more += [TIME] if TIME in rel.df.columns else []
        return Working(rel.df.select(*cols, F.col("_ts").alias(f"{a}._ts"), "_ts", "_seq", *more), fields, [a])

    def select(self, q: Select, keys: list | None = None) -> Relation:
        """``keys``: inner columns that a correlated subquery is grouped by."""
        w = self.scan(q.source, keyed=q.latest_by is not None and not q.joins)
        for j in q.joins:
            w = self.join(w, j)
        q = self._expand(q, w)
        shown = [i.alias or default_name(i.expr, k) for k, i in enumerate(q.items)]
        twice = next((n for n in shown if shown.count(n) > 1), None)
        if twice is not None:
            raise SqlError(f"Two output columns are named '{twice}'")
        for item in q.items:
            item.expr = self._registered(item.expr)
        w = self.where(w, q.where)
        aggregated = any(isinstance(n, Agg) for i in q.items for n in walk(i.expr))
        grouped = aggregated or q.group_by is not None or q.group_all
        if q.latest_by is not None:
            if grouped or q.window:
                raise SqlError("LATEST BY excludes GROUP BY, aggregates and WINDOW")
            if self.mode == "pipeline":
                raise SqlError("LATEST BY is for tables")
            return self.latest(w, q)
        if q.window and self.mode == "table":
            raise SqlError("WINDOW is for pipelines")
        if q.emit_changes and not q.window:
            raise SqlError("EMIT needs WINDOW")
        if grouped or q.window:
            if self.mode == "pipeline" and not q.window:
                raise SqlError("GROUP BY and aggregates need WINDOW in a pipeline")
            return self.aggregate(w, q, keys or [])
        return self.project(w, q)

    def _registered(self, x):
        """Calls of registered aggregates as aggregates."""
        if isinstance(x, tuple):
            return tuple(self._registered(y) for y in x)
        if isinstance(x, Fn) and x.name in self.registry.aggregates:
            if len(x.args) != 1:
                raise SqlError(f"{x.name} takes 1 argument", *x.at)
            return Agg(x.name, x.args[0])
        if isinstance(x, (Un, Bin, Path, Fn, Cast, If)):
            return type(x)(**{k: v if k == "at" else self._registered(v) for k, v in ((k, getattr(x, k)) for k in x.__dataclass_fields__)})
        return x

    def _expand(self, q: Select, w: Working) -> Select:
        items, group = [], q.group_by
        for item in q.items:
            if not isinstance(item, Star):
                items.append(item)
                continue
            if q.group_by is not None or q.group_all or q.window:
                raise SqlError("* can't be selected with GROUP BY or WINDOW")
            aliases = [item.alias] if item.alias else w.aliases
            if item.alias and item.alias not in w.aliases:
                raise SqlError(f"Unknown alias '{item.alias}'")
            for a, f in w.fields:
                if a in aliases and f != "_ts":
                    items.append(Item(Col(f, a), f if len(aliases) == 1 else f"{a}_{f}"))
        if q.group_all:
            group = [i.expr for i in items if not any(isinstance(n, Agg) for n in walk(i.expr))]
        return Select(items, q.source, q.joins, q.where, group, False, q.latest_by, q.window, q.emit_changes)

    # Joins

    def join(self, w: Working, j: Join) -> Working:
        if j.kind == "unnest":
            array = self.expr(j.unnest, w)
            if array.kind != "json":
                raise SqlError("UNNEST takes a JSON array")
            name = f"{j.alias}.value"
            # Elements stay variants until something reads them; what isn't an array has no rows.
            df = w.df.withColumn(name, F.explode(F.from_json(array.col, "array<variant>")))
            return Working(df, {**w.fields, (j.alias, j.alias): (name, "variant")}, [*w.aliases, j.alias])
        if self.mode == "table" and j.within is not None:
            raise SqlError("WITHIN is for pipelines")
        if self.mode == "pipeline" and j.within is None:
            raise SqlError("A pipeline's join needs WITHIN")
        r = self.scan(j.source)
        if set(w.aliases) & set(r.aliases):
            raise SqlError(f"Duplicate alias '{j.source.alias}'")
        left = w.df.withColumnsRenamed({"_ts": "_lts", "_seq": "_lseq", TIME: "_ltime"})
        right = r.df.withColumnsRenamed({"_ts": "_rts", "_seq": "_rseq", TIME: "_rtime"})
        both = Working(left, {**w.fields, **r.fields}, [*w.aliases, *r.aliases])
        cond, drop = None, []
        if j.on is not None:
            keys = [c for c in conjuncts(j.on) if isinstance(c, Bin) and c.op == "=" and self._sides(c, w, r)]
            if not keys:
                raise SqlError("A join needs an equality between its sides")
            for c in conjuncts(j.on):
                x = B.truth(self.expr(c, both))
                cond = x if cond is None else cond & x
        if left.isStreaming or right.isStreaming:
            # The state of a stream's join is bounded by a range of event times.
            if j.within is None or j.kind == "cross":
                raise SqlError("A stream's join needs WITHIN and an equality")
            span = F.expr(f"INTERVAL '{j.within // 1000}.{j.within % 1000:03d}' SECOND")
            near = (F.col("_rtime") >= F.col("_ltime") - span) & (F.col("_rtime") <= F.col("_ltime") + span)
            df = left.join(right, cond & near, {"full": "full_outer"}.get(j.kind, j.kind)).drop("_ltime", "_rtime")
        elif j.within is not None:
            df = self._near(left, right, cond, j)
        elif cond is None:
            df = left.crossJoin(right)
        else:
            df = left.join(right, cond, {"full": "full_outer"}.get(j.kind, j.kind))
        df = df.withColumn("_ts", F.greatest("_lts", "_rts")).withColumn("_seq", F.greatest("_lseq", "_rseq"))
        return Working(df.drop("_lts", "_rts", "_lseq", "_rseq"), both.fields, both.aliases)

    @staticmethod
    def _near(left: DataFrame, right: DataFrame, cond: Column | None, j: Join) -> DataFrame:
        """A join of rows at most ``within`` apart.  Buckets of the span bound the pairs that meet under one key:
        the side whose rows are kept whole stands in its bucket, the other in three."""
        near = F.abs(F.col("_lts") - F.col("_rts")) <= j.within
        cond = near if cond is None else cond & near
        span = max(1, j.within)
        own = lambda ts: F.floor(F.col(ts) / span)
        spread = lambda ts: F.explode(F.array(*[own(ts) + d for d in (-1, 0, 1)]))
        met = cond & (F.col("_lb") == F.col("_rb"))
        if j.kind == "right":
            return left.withColumn("_lb", spread("_lts")).join(right.withColumn("_rb", own("_rts")), met, "right").drop("_lb", "_rb")
        how = "inner" if j.kind == "cross" else "left" if j.kind == "full" else j.kind
        out = left.withColumn("_lb", own("_lts")).join(right.withColumn("_rb", spread("_rts")), met, how).drop("_lb", "_rb")
        if j.kind == "full":
            alone = right.withColumn("_rb", own("_rts")).join(left.withColumn("_lb", spread("_lts")), met, "left_anti").drop("_rb")
            out = out.unionByName(alone, allowMissingColumns=True)
        return out

    def _sides(self, c: Bin, w: Working, r: Working) -> bool:
        def of(x) -> set[int]:
            return {k for n in walk(x) if isinstance(n, Col) for k, s in enumerate((w, r)) if s.find(n)}

        return {frozenset(of(c.left)), frozenset(of(c.right))} == {frozenset({0}), frozenset({1})}

    # Conditions

    def where(self, w: Working, cond) -> Working:
        plain = []
        for c in conjuncts(cond):
            if isinstance(c, InQuery):
                w = self.member(w, c)
            elif isinstance(c, Exists):
                w = self.exists(w, c)
            else:
                if any(isinstance(n, (InQuery, Exists)) for n in walk(c)):
                    raise SqlError("IN and EXISTS stand alone or under AND in WHERE")
                w, c = self.scalars(w, c)
                plain.append(c)
        for c in plain:
            holds = B.truth(self.expr(c, w))
            # Retractions of keys have nothing but the key and pass every condition.
            holds = holds | F.coalesce(F.col("_retract"), F.lit(False)) if "_retract" in w.df.columns else holds
            # Rows that a stream's filter drops still move its watermark: a condition on the event time stays above it.
            holds = F.when(F.col(TIME).isNotNull(), holds) if TIME in w.df.columns else holds
            w = Working(w.df.filter(holds), w.fields, w.aliases)
        return w

    def visible(self, w: Working, rel: Relation, query: Select) -> DataFrame:
        """``w`` with ``_vis``: the end of the latest window of ``rel`` with rows that had
        closed, lateness included, when the row came; null before the first.

        Ends have a row per window, so their order is cheap; rows find their interval
        between two ends by the cell of time that it covers."""
        if "window_end" not in rel.df.columns:
            raise SqlError("A pipeline's subquery needs WINDOW")
        size = query.window.size if query.window else 3_600_000
        ends = rel.df.select(F.col("window_end").alias("_e")).distinct()
        after = F.lead("_e").over(Window.orderBy("_e"))
        spans = ends.withColumn("_from", F.col("_e") + LATENESS).withColumn("_to", after + LATENESS).filter("_to is not null")
        cell = lambda t: F.floor(t / size).cast("bigint")
        cells = spans.withColumn("_c", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to") - 1))))
        last = F.broadcast(ends.agg(F.max("_e").alias("_last")))  # one row
        near = (cell(F.col("_ts")) == F.col("_c")) & (F.col("_ts") >= F.col("_from")) & (F.col("_ts") < F.col("_to"))
        found = w.df.join(cells, near, "left").crossJoin(last)
        vis = F.coalesce(F.col("_e"), F.when(F.col("_ts") >= F.col("_last") + LATENESS, F.col("_last")))
        return found.withColumn("_vis", vis).drop("_e", "_from", "_to", "_c", "_last")

    def member(self, w: Working, c: InQuery) -> Working:
        rel = self.select(c.query)
        if len(rel.kinds) != 1:
            raise SqlError("An IN subquery has one column")
        name = next(iter(rel.kinds))
        own = self.expr(c.arg, w)
        cols, df = [F.col(f"`{name}`").alias("_member")], w.df
        if self.mode == "pipeline":
            df = self.visible(w, rel, c.query)
            cols.append(F.col("window_end").alias("_end"))
        inner = rel.df.select(*cols).filter("_member is not null")
        cond = B.compare("=", own, Typed(F.col("_member"), rel.kinds[name])).col
        if self.mode == "pipeline":
            cond = cond & (F.col("_vis") == F.col("_end"))
        # NULLs of the subquery are ignored, and a NULL on the outside is in neither.
        df = df.filter(own.col.isNotNull()) if c.negated else df
        return Working(df.join(inner, cond, "left_anti" if c.negated else "left_semi").drop("_vis"), w.fields, w.aliases)

    def exists(self, w: Working, c: Exists) -> Working:
        if self.mode == "pipeline":
            rel = self.select(c.query)
            seen = self.visible(w, rel, c.query)
            return Working(seen.filter(F.col("_vis").isNull() if c.negated else F.col("_vis").isNotNull()).drop("_vis"), w.fields, w.aliases)
        one = self.select(c.query).df.select(F.lit(1).alias("_one")).limit(1)
        count = F.broadcast(one.agg(F.count("*").alias("_n")))  # one row
        df = w.df.crossJoin(count).filter(F.col("_n") == (0 if c.negated else 1)).drop("_n")
        return Working(df, w.fields, w.aliases)

    def scalars(self, w: Working, x):
        """Joins the scalar subqueries of an expression and puts their columns in their place."""
        if isinstance(x, Scalar):
            return self.scalar(w, x)
        if isinstance(x, tuple):
            out = []
            for y in x:
                w, y = self.scalars(w, y)
                out.append(y)
            return w, tuple(out)
        if isinstance(x, (Un, Bin, Path, Fn, Agg, Cast, If)):
            new = {}
            for k in x.__dataclass_fields__:
                value = getattr(x, k)
                if not isinstance(value, (str, int, float, type(None))) and k != "at":
                    w, value = self.scalars(w, value)
                new[k] = value
            return w, type(x)(**new)
        return w, x

    def scalar(self, w: Working, x: Scalar):
        q = x.query
        if len(q.items) != 1 or q.group_by is not None or not any(isinstance(n, Agg) for n in walk(q.items[0].expr)):
            raise SqlError("A scalar subquery is one aggregate without GROUP BY")
        inner = self.scan(q.source)
        for j in q.joins:
            inner = self.join(inner, j)
        keys, rest = [], None
        for c in conjuncts(q.where):
            outside = [n for n in walk(c) if isinstance(n, Col) and not inner.find(n)]
            if not outside:
                rest = c if rest is None else Bin("AND", rest, c)
                continue
            if not (isinstance(c, Bin) and c.op == "="):
                raise SqlError("A subquery is correlated by equality only")
            a, b = (c.left, c.right) if not [n for n in walk(c.left) if isinstance(n, Col) and not inner.find(n)] else (c.right, c.left)
            if [n for n in walk(a) if isinstance(n, Col) and not inner.find(n)]:
                raise SqlError("A subquery is correlated by equality only")
            keys.append((a, b))
        rel = self.select(Select(q.items, q.source, q.joins, rest, [a for a, _ in keys] or None, window=q.window), keys=[a for a, _ in keys])
        k = sum(1 for name in w.fields if name[0].startswith("_sub"))
        value, alias = next(iter(rel.kinds)), f"_sub{k}"
        inner_df = rel.df.select(F.col(f"`{value}`").alias(alias), *[F.col(f"_key{n}").alias(f"{alias}k{n}") for n in range(len(keys))], *([F.col("window_end").alias("_end")] if self.mode == "pipeline" else []))
        how = "inner" if self.mode == "table" else "left"
        if keys or self.mode == "pipeline":
            cond, outer = None, w.df
            if self.mode == "pipeline":
                outer = self.visible(w, rel, q)
                cond = F.col("_vis") == F.col("_end")
            for n, (_, b) in enumerate(keys):
                c = self.expr(b, w).col == F.col(f"{alias}k{n}")
                cond = c if cond is None else cond & c
            df = outer.join(inner_df, cond, how).drop("_vis", "_end")
        else:
            df = w.df.join(F.broadcast(inner_df), F.lit(True), how)  # a global aggregate: one row at most
        name = Col("value", alias)
        return Working(df, {**w.fields, (alias, "value"): (alias, rel.kinds[value])}, [*w.aliases, alias]), name

    # Projection and aggregation

    def project(self, w: Working, q: Select) -> Relation:
        label = ",".join(a for a in w.aliases if not a.startswith("_sub"))
        cols, kinds = [], {}
        for k, item in enumerate(q.items):
            w, expr = self.scalars(w, item.expr)
            x = self.expr(expr, w)
            name = item.alias or default_name(item.expr, k)
            x = B.plain(x)
            cols.append(x.col.alias(name))
            kinds[name] = x.kind
        return Relation(w.df.select(*cols, "_ts", F.lit(label).alias("_source"), "_seq"), kinds)

    def latest(self, w: Working, q: Select) -> Relation:
        """The row with the largest event time of each key, ties to the later arrival;
        an aggregate, so it combines before the shuffle and no key needs sorting."""
        keys = [self.expr(k, w).col.alias(f"_k{n}") for n, k in enumerate(q.latest_by)]
        rel = self.project(w, q)
        cols = [*rel.kinds, "_ts", "_source", "_seq"]
        named = {c: B.plain(self.expr(i.expr, w)).col for c, i in zip(rel.kinds, q.items)}
        label = ",".join(w.aliases)
        shown = [x.alias(c) for c, x in named.items()]
        if "_retract" in w.df.columns:
            names = [f"_k{n}" for n in range(len(keys))]
            rows = w.df.select(*keys, *shown, "_ts", F.lit(label).alias("_source"), "_seq", "_retract")
            return Relation(zset.latest_by(rows, names).select(*cols), rel.kinds)
        row = F.struct(*shown, F.col("_ts"), F.lit(label).alias("_source"), F.col("_seq"))
        best = w.df.groupBy(*keys).agg(F.max_by(row, F.struct("_ts", "_seq")).alias("r"))
        return Relation(best.select(*[F.col("r").getField(c).alias(c) for c in cols]), rel.kinds)

    def aggregate(self, w: Working, q: Select, keys: list) -> Relation:
        items = []
        for item in q.items:
            w, expr = self.scalars(w, item.expr)
            items.append((item, expr))
        group = list(q.group_by or [])
        df, kinds_of_group = w.df, {}
        names = []
        for n, g in enumerate(group):
            x = B.plain(self.expr(g, w))
            df = df.withColumn(f"_g{n}", x.col)
            kinds_of_group[g] = (f"_g{n}", x.kind)
            names.append(f"_g{n}")
        aggs: dict[Agg, tuple[str, str]] = {}
        built = []
        for _, expr in items:
            for node in walk(expr):
                if isinstance(node, Agg) and node not in aggs:
                    if node.arg is not None and any(isinstance(n, Agg) for n in walk(node.arg)):
                        raise SqlError("Aggregates can't be nested")
                    make, kind = self.aggregator(node, w)
                    aggs[node] = (f"_a{len(aggs)}", kind)
                    built.append((f"_a{len(aggs) - 1}", make))
        bounds: list[str] = []
        if q.window and not df.isStreaming:
            df, bounds = self._windowed(df, q.window)
        by = [*names, *bounds]
        if q.window and df.isStreaming:
            final, bounds = self._streamed(df, names, q, built), ["_wstart", "_wend"]
        elif q.window and q.window.kind == "session":
            gap = q.window.size
            if q.emit_changes:
                # Steps need the session of each row; its number is the count of gaps before it.
                order = Window.partitionBy(*names).orderBy("_ts")
                first = F.coalesce(F.col("_ts") - F.lag("_ts").over(order) > gap, F.lit(False))
                df = df.withColumn("_first", first.cast("bigint"))
                df = df.withColumn("_session", F.sum("_first").over(order.rangeBetween(Window.unboundedPreceding, 0)))
                by = [*names, "_session"]
                ends = [("_wstart", lambda spec: F.min("_ts") if spec is None else F.min("_ts").over(spec)), ("_wend", lambda spec: F.max("_ts") if spec is None else F.max("_ts").over(spec))]
                built = [*built, *ends]
                final = df.groupBy(*by).agg(F.max("_seq").alias("_seq"), *[m(None).alias(c) for c, m in built])
            else:
                session = F.session_window(F.timestamp_millis("_ts"), f"{gap} milliseconds").alias("_w")
                final = df.groupBy(*names, session).agg(F.max("_seq").alias("_seq"), *[m(None).alias(c) for c, m in built])
                final = final.withColumn("_wstart", F.unix_millis("_w.start")).withColumn("_wend", F.unix_millis("_w.end") - gap).drop("_w")
            bounds = ["_wstart", "_wend"]
        else:
            final = df.groupBy(*by).agg(F.count("*").alias("_rows"), F.max("_seq").alias("_seq"), *[m(None).alias(c) for c, m in built])
            if not by:
                final = final.filter("_rows > 0")
        if q.emit_changes:
            over = Window.partitionBy(*by).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
            running = dict(built)
            for node, (name, _) in aggs.items():
                if node.distinct:
                    # A running count of distinct values counts the first row of each.
                    x = self.expr(node.arg, w).col
                    first = F.row_number().over(Window.partitionBy(*by, x).orderBy("_seq")) == 1
                    df = df.withColumn(f"_first{name}", (first & x.isNotNull()).cast("bigint"))
                    running[name] = lambda spec, c=f"_first{name}": F.sum(c).over(spec)
            steps = df.select(*by, "_seq", *[m(over).alias(c) for c, m in running.items()]).withColumn("_final", F.lit(False))
            final = steps.unionByName(final.withColumn("_final", F.lit(True)).drop("_rows"))
        out, kinds = [], {}
        scope = Working(final, {}, w.aliases)
        for k, (item, expr) in enumerate(items):
            x = self.post(expr, kinds_of_group, aggs, scope)
            name = item.alias or default_name(item.expr, k)
            out.append(x.col.alias(name))
            kinds[name] = x.kind
        extra = [F.col(kinds_of_group[g][0]).alias(f"_key{n}") for n, g in enumerate(keys)]
        if bounds:
            extra += [F.col(bounds[0]).alias("window_start"), F.col(bounds[1]).alias("window_end")]
        if q.emit_changes:
            extra.append(F.col("_final"))
        ts = F.col(bounds[1]) if bounds else F.lit(0).cast("bigint")
        label = ",".join(a for a in w.aliases if not a.startswith("_sub"))
        return Relation(final.select(*out, *extra, ts.alias("_ts"), F.lit(label).alias("_source"), "_seq"), kinds)

    @staticmethod
    def _streamed(df: DataFrame, names: list[str], q: Select, built: list) -> DataFrame:
        """Final rows of a stream's windows, each when the watermark has passed it."""
        if q.emit_changes:
            raise SqlError("EMIT CHANGES of a stream isn't supported")
        if TIME not in df.columns:
            raise SqlError("A window over a stream's join needs a view between them")
        size, step = q.window.size, q.window.advance or q.window.size
        aggs = [F.max("_seq").alias("_seq"), *[m(None).alias(c) for c, m in built]]
        if q.window.kind == "session":
            # Sessions of a stream need a key.
            w = F.session_window(TIME, f"{size} milliseconds").alias("_w")
            out = df.withColumn("_all", F.lit(1)).groupBy("_all", *names, w).agg(*aggs).drop("_all")
            return out.withColumn("_wstart", F.unix_millis("_w.start")).withColumn("_wend", F.unix_millis("_w.end") - size).drop("_w")
        gaps = step > size
        rows = df.filter(F.pmod("_ts", F.lit(step)) < size) if gaps else df
        w = F.window(TIME, f"{step if gaps else size} milliseconds", f"{step} milliseconds").alias("_w")
        out = rows.groupBy(*names, w).agg(*aggs)
        return out.withColumn("_wstart", F.unix_millis("_w.start")).withColumn("_wend", F.col("_wstart") + size).drop("_w")

    def _windowed(self, df: DataFrame, window) -> tuple[DataFrame, list[str]]:
        ts, size = F.col("_ts"), window.size
        if window.kind == "session":
            return df, []
        if window.kind == "tumbling":
            df = df.withColumn("_wstart", ts - F.pmod(ts, F.lit(size)))
        else:
            step = window.advance
            last = ts - F.pmod(ts, F.lit(step))
            first = last - F.floor((F.lit(size) - 1 - (ts - last)) / step) * step
            df = df.withColumn("_wstart", F.explode(F.when(ts - last < size, F.sequence(first, last, F.lit(step).cast("bigint")))))
        return df.withColumn("_wend", F.col("_wstart") + size), ["_wstart", "_wend"]

    def aggregator(self, node: Agg, w: Working):
        """A function from a window specification or None to the aggregate, and its kind."""
        over = lambda c, spec: c if spec is None else c.over(spec)
        if node.arg is None:
            return (lambda spec: over(F.count("*"), spec)), "long"
        x = self.expr(node.arg, w)
        own = self.registry.aggregates.get(node.name)
        if own is not None:
            return (lambda spec: over(own.build(x.col), spec)), own.kind
        if node.name == "count":
            if node.distinct:
                alone = F.size(F.collect_set(x.col)).cast("bigint") if w.df.isStreaming else F.count_distinct(x.col)
                return (lambda spec: alone if spec is None else F.size(F.collect_set(x.col).over(spec)).cast("bigint")), "long"
            return (lambda spec: over(F.count(x.col), spec)), "long"
        if node.name in ("min", "max"):
            f = F.min if node.name == "min" else F.max
            y = B.leaf_number(x)
            return (lambda spec: over(f(y.col), spec)), y.kind
        n = B.leaf_number(x)
        value = n.col if n.kind in B.NUMBERS else F.lit(None).cast("bigint")
        if node.name == "sum":
            kind = n.kind if n.kind in B.NUMBERS else "long"
            if kind == "long":
                return (lambda spec: B.wrapped_sum(lambda c: over(F.sum(c), spec), value)), kind
            return (lambda spec: F.coalesce(over(F.sum(value), spec), F.lit(0.0))), kind
        value = value.cast("double")
        if node.name in ("median", "percentile_cont"):
            p = 0.5 if node.name == "median" else node.parameter
            return (lambda spec: over(F.percentile(value, F.lit(p)), spec)), "double"
        f = {"avg": F.avg, "var_samp": F.var_samp, "var_pop": F.var_pop, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop}[node.name]
        return (lambda spec: over(f(value), spec)), "double"

    def post(self, x, group: dict, aggs: dict, w: Working) -> Typed:
        """An expression over groups and aggregates."""
        for g, (name, kind) in group.items():
            if g == x or (isinstance(x, Col) and isinstance(g, Col) and g.name.lower() == x.name.lower() and None in (g.alias, x.alias)):
                return Typed(F.col(name), kind)
        if isinstance(x, Agg):
            return Typed(F.col(aggs[x][0]), aggs[x][1])
        if isinstance(x, Col):
            raise SqlError(f"Column '{x.name}' is neither grouped nor aggregated", *x.at)
        return self.expr(x, w, lambda y: self.post(y, group, aggs, w))

    # Expressions

    def expr(self, x, w: Working, inner=None) -> Typed:
        go = inner or (lambda y: self.expr(y, w))
        if isinstance(x, Lit):
            return B.literal(x.value)
        if isinstance(x, Col):
            found = w.find(x)
            if found is None and x.alias is None:
                found = w.find(Col(x.name, x.name))  # the element of an UNNEST
            if found is None:
                raise SqlError(f"Unknown column '{x.alias + '.' if x.alias else ''}{x.name}'", *x.at)
            return found
        if isinstance(x, Path):
            steps, base = [], x
            while isinstance(base, Path):
                steps.insert(0, base.step)
                base = base.base
            root = go(base)
            if root.kind == "variant":
                return B.variant_path(root.col, steps, x.text)
            if root.kind not in ("json", "string"):
                raise SqlError("-> takes a JSON value")
            return B.json_path(root.col, steps, x.text)
        if isinstance(x, Un):
            arg = go(x.arg)
            if x.op == "NOT":
                return Typed(~B.truth(arg), "bool")
            arg = B.leaf_number(arg)
            return B.negate(arg) if arg.kind in B.NUMBERS else B.null("long")
        if isinstance(x, Bin):
            a, b = go(x.left), go(x.right)
            if x.op in ("AND", "OR"):
                return Typed(B.truth(a) & B.truth(b) if x.op == "AND" else B.truth(a) | B.truth(b), "bool")
            if x.op in ("=", "!=") and "json" in (B.plain(a).kind, B.plain(b).kind) and Lit(None) in (x.left, x.right):
                return B.null("bool")
            B.guard_json(x.op, a, b)
            return B.arithmetic(x.op, a, b) if x.op in ("+", "-", "*", "/", "%") else B.compare(x.op, a, b)
        if isinstance(x, If):
            then, other = B.unify(B.plain(go(x.then)), B.plain(go(x.other)))
            return Typed(F.when(B.truth(go(x.cond)), then.col).otherwise(other.col), then.kind)
        if isinstance(x, Cast):
            return B.conversion(x.kind, B.plain(go(x.arg)))
        if isinstance(x, Fn):
            args = [B.plain(go(a)) for a in x.args]
            own = self.registry.scalars.get(x.name)
            if own is not None:
                if len(args) not in own.arity:
                    raise SqlError(f"{x.name} takes {' or '.join(map(str, own.arity))} arguments", *x.at)
                return Typed(own.build(args), own.kind([a.kind for a in args]))
            return B.call(x.name, args, list(x.args))
        if isinstance(x, Agg):
            raise SqlError("An aggregate can't stand here")
        raise SqlError("This expression can't stand here")
