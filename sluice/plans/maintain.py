"""Maintained views: a table statement that turns batches of changes into net changes of its result.

A statement becomes a tree of small steps over weighted rows.  Projections, filters and
UNNEST are linear: they work on changes alone.  Joins of two sides, groups, LATEST BY,
semi- and anti-joins and distinct are *keyed*: the result for a key depends on the rows
of that key only, so a batch reads the rows of the keys that it touches, computes their
part of the result before and after, and gives the difference.  LATEST BY keeps just the
current row of a key.  Statements with scalar subqueries or EXISTS have one key: a batch computes them anew.

A keyed step stores its input rows as a log of Parquet folders, one per batch, whose rows are dealt and sorted by a hash of the key
into ``BUCKETS`` buckets; a batch reads the row groups with buckets that it touches.  After ``COMPACT`` batches the log is
rewritten as one.  A batch reads batches of smaller numbers only and overwrites its own folder, so it can be applied
again, and a view that is opened over an old path goes on where its last finished batch ended.

Defined results: a retraction takes back an equal row whatever its arrival number; retractions that come
early wait; a null key is a key of groups and of LATEST BY, and joins nothing; a batch without rows changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import zset
from ..operators.zset import W
from ..sql.ast import Agg, Bin, Cast, Col, Exists, Fn, If, InQuery, Item, Join, Lit, Path, Scalar, Select, Source, SqlError, Un, Union
from ..sql.parser import parse, sources, split_sink
from ..storage import fresh_path, shared_dir
from . import engine as E

BUCKETS = 1024
COMPACT = 16
#: Rows that a task nets: what it holds in memory doesn't grow with the view.
ROWS = 1 << 17
#: A batch reads whole buckets if they have at most so many rows a touched key.
NEAR = 16
KEY = "_k"
#: The weight of a row while a statement is run over it.
HIDDEN = "_w"


def net(deltas: DataFrame) -> DataFrame:
    """One row per content; the arrival number is the latest."""
    by = [F.col(f"`{c}`") for c in identity(deltas)]
    return deltas.groupBy(*by).agg(F.sum(W).alias(W), F.max("_seq").alias("_seq")).filter(F.col(W) != 0).select(*[f"`{c}`" for c in deltas.columns])


def bag(deltas: DataFrame) -> DataFrame:
    """The visible rows, each as often as it weighs."""
    seen = deltas.filter(F.col(W) > 0)
    return seen.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(W)))).drop("_n", W)


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Deltas that aren't net yet."""
    weigh = lambda df, w: df.withColumn(W, F.lit(w).cast("bigint"))
    return weigh(after, 1).unionByName(weigh(before, -1))


def dealt(rows: DataFrame, count: int, by: list[str]) -> DataFrame:
    """In as many partitions as the number of rows asks for; what groups by these columns, or joins by them, needs no other exchange."""
    return rows.repartition(max(1, -(-count // ROWS)), *[F.col(f"`{c}`") for c in by])


def identity(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in (W, "_seq")]


class Touched:
    """The keys of a batch's deltas."""

    def __init__(self, deltas: list[DataFrame], buckets: int = BUCKETS):
        own = None
        for rows in deltas:
            own = rows.select(KEY) if own is None else own.union(rows.select(KEY))
        self.keys = own.distinct()
        # At most ``buckets`` rows.
        by = own.groupBy(KEY).agg(F.count("*").alias("n")).groupBy(F.pmod(KEY, F.lit(buckets)).alias("b"))
        found = by.agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()
        self.buckets = [r["b"] for r in found]
        self.count, self.rows = sum(r["keys"] for r in found), sum(r["n"] for r in found)
        #: No bucket stands out, so no key has many of the rows.
        self.even = max((r["n"] for r in found), default=0) <= ROWS + 4 * self.rows // buckets


class Store:
    """Weighted rows by key, as a log of batches: a folder per number, and one of all up to a number after compaction.

    What a folder needs to count is its mark of success, so a store that is opened again finds what was finished."""

    def __init__(self, spark, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.batches: dict[int, str] = {}
        self.counts: dict[str, int] = {}
        self.schema = None
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
        names = [f.getPath().getParent().getName() for f in found]
        floor = max((int(n.removeprefix("upto-")) for n in names if n.startswith("upto-")), default=-1)
        for n in names:
            if n == f"upto-{floor}" or (n.startswith("batch-") and int(n.removeprefix("batch-")) > floor):
                self.batches[int(n.partition("-")[2])] = n
        if self.batches:
            one = spark.read.parquet(f"{path}/{next(iter(self.batches.values()))}").drop("_b")
            self.schema = one.schema

    def _write(self, rows: DataFrame, name: str) -> None:
        # As many files as the size asks for; a small batch is one.
        dealt = rows.withColumn("_b", F.pmod(KEY, F.lit(self.buckets))).repartition("_b").sortWithinPartitions("_b")
        dealt.write.mode("overwrite").parquet(f"{self.path}/{name}")
        self.counts.pop(name, None)

    def append(self, rows: DataFrame, number: int) -> None:
        self.schema = self.schema or rows.schema
        self._write(rows, f"batch-{number}")
        self.batches = {n: b for n, b in self.batches.items() if n < number} | {number: f"batch-{number}"}
        if len(self.batches) > COMPACT:
            # The batch itself stays apart: it may be applied again.
            last = max(n for n in self.batches if n < number)
            self._write(net(self.read(number)), f"upto-{last}")
            self.batches = {last: f"upto-{last}", number: f"batch-{number}"}

    def read(self, before: int | None = None) -> DataFrame | None:
        """All rows of batches of a smaller number."""
        out = None
        for name in self._names(before):
            rows = self._folder(name)
            out = rows if out is None else out.unionByName(rows)
        return out

    def batch(self, number: int) -> DataFrame:
        """The rows of one batch."""
        return self._folder(self.batches[number]).drop("_b")

    def count(self, before: int | None = None) -> int:
        """Of the rows that ``read`` gives; from the files' footers."""
        for name in self._names(before):
            if name not in self.counts:
                self.counts[name] = self._folder(name).count()
        return sum(self.counts[name] for name in self._names(before))

    def _names(self, before: int | None) -> list[str]:
        return [b for n, b in sorted(self.batches.items()) if before is None or n < before]

    def _folder(self, name: str) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema or ())
        return self.spark.read.schema(f"{fields}, _b bigint").parquet(f"{self.path}/{name}")

    def of(self, touched: Touched, number: int) -> tuple[DataFrame, int] | None:
        """Deltas before batch ``number``, of all keys in ``touched`` and perhaps of others, and about how many; None if nothing was stored.

        Other keys are the same before and after the batch.  They are left out if that saves more than it costs."""
        rows = self.read(number)
        if rows is None:
            return None
        if len(touched.buckets) < self.buckets:
            rows = rows.filter(F.col("_b").isin(touched.buckets))
        count = self.count(number) * len(touched.buckets) // self.buckets
        rows = rows.drop("_b")
        return (rows if count <= NEAR * touched.count else rows.join(touched.keys, KEY, "left_semi")), count


class Step:
    kinds: dict[str, str]

    def changes(self, batch: dict[str, DataFrame], number: int) -> DataFrame | None:
        """Columns of ``kinds``, ``_ts``, ``_seq`` and ``_weight``; None without changes."""
        raise NotImplementedError


class View:
    """What the steps of one statement share."""

    def __init__(self, engine: "E.Engine", path: str | None = None):
        self.engine, self.spark = engine, engine.spark
        shared_dir(self.spark)
        self.path = path or fresh_path(self.spark, "view")
        self.stores = 0

    def store(self) -> Store:
        self.stores += 1
        return Store(self.spark, f"{self.path}/store-{self.stores}")

    def run(self, q, inputs: dict[str, tuple[DataFrame, dict[str, str]]]) -> "E.Relation":
        """A statement over the named inputs, by the batch engine."""
        unit = E.Engine(self.spark, "table")
        unit.registry = self.engine.registry
        unit.relations = {n: E.Relation(df.withColumn("_source", F.lit(n)), kinds) for n, (df, kinds) in inputs.items()}
        rel = unit.relation(q)
        return E.Relation(rel.df.select(*[f"`{c}`" for c in rel.kinds], "_ts", F.col("_seq").cast("bigint").alias("_seq")), rel.kinds)

    def empty(self, kinds: dict[str, str]) -> DataFrame:
        # Catalyst sees that no row is there, and leaves out what would read it.
        fields = [*((c, E.SPARK[k]) for c, k in kinds.items()), ("_ts", "bigint"), ("_seq", "bigint")]
        return self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in fields]).limit(0)

    def keyed(self, rows: DataFrame, alias: str, name: str, kinds: dict[str, str], keys: list, numbers: list[bool]) -> DataFrame:
        """``rows`` with ``_k``, a hash of key expressions over them; equal numbers of either kind hash alike."""
        unit = E.Engine(self.spark, "table")
        unit.registry = self.engine.registry
        scope = E.Working(rows, {(alias, f): (f, k) for f, k in kinds.items()} | {(alias, "_ts"): ("_ts", "long")}, [alias])
        cols = []
        for key, number in zip(keys, numbers):
            x = unit.expr(key, scope)
            cols.append(x.col.cast("double") + 0.0 if number else x.col.cast("string"))
        return rows.withColumn(KEY, F.xxhash64(*cols) if cols else F.lit(0).cast("bigint"))


class Base(Step):
    def __init__(self, view: View, name: str):
        self.view, self.name = view, name
        if name not in view.engine.relations:
            raise SqlError(f"Unknown relation '{name}'")
        self.kinds = view.engine.relations[name].kinds

    def raw(self, batch: dict[str, DataFrame], number: int) -> DataFrame | None:
        rows = batch.get(self.name)
        if rows is None:
            return None
        if "_seq" not in rows.columns:
            rows = rows.withColumn("_seq", F.lit(number).cast("bigint"))
        own = E.Engine(self.view.spark).register(self.name, rows, json=tuple(c for c, k in self.kinds.items() if k == "json"))
        return own.relations[self.name].df

    def changes(self, batch, number):
        rows = self.raw(batch, number)
        return None if rows is None else zset.as_deltas(rows).select(*[f"`{c}`" for c in self.kinds], "_ts", "_seq", W)


class Linear(Step):
    """A projection, filter or UNNEST: each row keeps its weight."""

    def __init__(self, view: View, child: Step, make: Callable[[str], Select]):
        """``make``: the statement over a relation of that name."""
        self.view, self.child, q = view, child, make("_in")
        self.kinds = view.run(q, {"_in": (view.empty(child.kinds), child.kinds)}).kinds
        self.q = Select([*q.items, Item(Col(HIDDEN, q.source.alias), HIDDEN)], q.source, q.joins, q.where)

    def changes(self, batch, number):
        rows = self.child.changes(batch, number)
        if rows is None:
            return None
        weighed = rows.withColumnRenamed(W, HIDDEN)
        out = self.view.run(self.q, {"_in": (weighed, self.child.kinds | {HIDDEN: "long"})}).df
        return out.select(*[f"`{c}`" for c in self.kinds], "_ts", "_seq", F.col(HIDDEN).alias(W))


class Keyed(Step):
    """``inputs``: name to child, alias and key expressions; ``q``: the statement over the inputs."""

    def __init__(self, view: View, q, inputs: dict[str, tuple[Step, str, list]]):
        self.view, self.q, self.inputs = view, q, inputs
        self.kinds = view.run(q, {n: (view.empty(c.kinds), c.kinds) for n, (c, _, _) in inputs.items()}).kinds
        self.stores = {n: view.store() for n in inputs}
        # A key is compared as a number if it is one on any side.
        shapes = [[self._number(c, a, k) for k in keys] for c, a, keys in inputs.values()]
        self.numbers = [any(x) for x in zip(*shapes)]
        # Columns that two sides are joined by as they are.
        fields = {n: [k.name for k in keys if isinstance(k, Col) and k.name in c.kinds] for n, (c, _, keys) in inputs.items()}
        kinds = [[c.kinds[f] for f in fields[n]] for n, (c, _, _) in inputs.items()]
        self.joined = fields if len(inputs) == 2 and kinds[0] == kinds[1] and len(kinds[0]) == len(self.numbers) > 0 else None

    def _number(self, child: Step, alias: str, key) -> bool:
        scope = E.Working(self.view.empty(child.kinds), {(alias, f): (f, k) for f, k in child.kinds.items()}, [alias])
        unit = E.Engine(self.view.spark, "table")
        unit.registry = self.view.engine.registry
        return unit.expr(key, scope).kind in ("long", "double")

    def result(self, rows: dict[str, DataFrame]) -> DataFrame:
        out = self.view.run(self.q, {n: (df, self.inputs[n][0].kinds) for n, df in rows.items()}).df
        return out.withColumn("_seq", F.lit(0).cast("bigint"))

    def changes(self, batch, number):
        deltas = {}
        for name, (child, alias, keys) in self.inputs.items():
            rows = child.changes(batch, number)
            if rows is not None:
                self.stores[name].append(self.view.keyed(net(rows), alias, name, child.kinds, keys, self.numbers), number)
                deltas[name] = self.stores[name].batch(number)
        if not deltas:
            return None
        touched = Touched(list(deltas.values()))
        before, after, count = {}, {}, touched.rows
        for name, (child, _, _) in self.inputs.items():
            # What is read here are batches of smaller numbers and the deltas, whenever it is read.
            held = self.stores[name].of(touched, number)
            count += held[1] if held is not None else 0
            before[name] = after[name] = self.view.empty(child.kinds)
            if held is not None:
                both = self._both(*held, deltas.get(name), touched)
                before[name], after[name] = (bag(both.withColumnsRenamed({w: W, s: "_seq"})).select(before[name].columns) for w, s in (("_w0", "_s0"), ("_w1", "_s1")))
            elif name in deltas:
                after[name] = bag(deltas[name]).drop(KEY)
        if self.joined and touched.even:
            # A task's share of a join doesn't grow with the view; an uneven one is left to Spark, which splits large partitions.
            before, after = ({n: dealt(df, count, self.joined[n]) for n, df in rows.items()} for rows in (before, after))
        return difference(self.result(after), self.result(before))

    def _both(self, held: DataFrame, count: int, delta: DataFrame | None, touched: Touched) -> DataFrame:
        """Each row once, with its weights and arrival numbers before and after the batch."""
        none = F.lit(None).cast("bigint")
        rows = held.withColumnsRenamed({W: "_w0", "_seq": "_s0"}).withColumn("_dw", none).withColumn("_ds", none)
        if delta is not None:
            rows = rows.unionByName(delta.withColumnsRenamed({W: "_dw", "_seq": "_ds"}).withColumn("_w0", none).withColumn("_s0", none))
            count += touched.rows
        w0, added = F.coalesce(F.sum("_w0"), F.lit(0)), F.coalesce(F.sum("_dw"), F.lit(0))
        by = identity(held)
        # By the key, if none has many rows: a group's rows meet before they are summed.
        summed = dealt(rows, count, [KEY] if touched.even else by).groupBy(*[F.col(f"`{c}`") for c in by]).agg(w0.alias("_w0"), (w0 + added).alias("_w1"), F.max("_s0").alias("_s0"), F.max("_ds").alias("_ds"))
        kept = summed.filter("_w0 > 0 or _w1 > 0").withColumn("_s1", F.greatest(F.when(F.col("_w0") != 0, F.col("_s0")), F.col("_ds")))
        return kept.drop(KEY, "_ds").checkpoint()  # read twice


class Latest(Step):
    """LATEST BY: the store holds the current rows alone."""

    def __init__(self, view: View, q: Select, child: Step):
        self.view, self.q, self.child = view, q, child
        star = [Item(Col(f, q.source.alias), f) for f in child.kinds]
        self.current = Select(star, Source(q.source.alias, name="_in"), [], where=q.where, latest_by=q.latest_by)
        self.shown = Select(q.items, Source(q.source.alias, name="_in"), [])
        self.kinds = view.run(self.shown, {"_in": (view.empty(child.kinds), child.kinds)}).kinds
        self.store = view.store()

    def changes(self, batch, number):
        child, alias = self.child, self.q.source.alias
        rows = child.raw(batch, number) if isinstance(child, Base) else child.changes(batch, number)
        if rows is None:
            return None
        names = [*child.kinds, "_ts", "_seq"]
        # Without retractions of keys LATEST BY is one aggregate.
        flags = [F.coalesce(F.col("_retract"), F.lit(False)).alias("_retract")] if "_retract" in rows.columns else []
        weight = F.coalesce(F.col(W), F.lit(1)).cast("bigint") if W in rows.columns else F.lit(1).cast("bigint")
        numbers = [False] * len(self.q.latest_by)
        typed = rows.select(*[f"`{c}`" for c in names], weight.alias(W), *flags)
        keyed = self.view.keyed(typed, alias, "_in", child.kinds, self.q.latest_by, numbers).checkpoint()
        touched = Touched([keyed])
        found = self.store.of(touched, number)
        held = net(dealt(*found, identity(found[0]))).checkpoint() if found is not None else None  # read once, used three times
        asserted = keyed.filter("not _retract").drop("_retract") if flags else keyed
        before = bag(held).drop(KEY) if held is not None else self.view.empty(child.kinds)
        every, count = (zset.plus(held, asserted), found[1]) if held is not None else (asserted, 0)
        left = bag(net(dealt(every, count + touched.rows, identity(every)))).drop(KEY)
        if flags:
            left = left.withColumn("_retract", F.lit(False)).unionByName(keyed.filter("_retract").drop(W, KEY))
        after = self.view.run(self.current, {"_in": (left, child.kinds)}).df.checkpoint()
        change = net(difference(after, before))
        show = lambda df: self.view.run(self.shown, {"_in": (df, child.kinds)}).df
        self.store.append(self.view.keyed(change, alias, "_in", child.kinds, self.q.latest_by, numbers), number)
        return difference(show(after), show(before))


class All(Step):
    """UNION ALL; names and kinds are those of the first branch, numbers widened."""

    def __init__(self, view: View, children: list[Step], kinds: dict[str, str]):
        self.view, self.children, self.kinds = view, children, kinds

    def changes(self, batch, number):
        out = None
        for child in self.children:
            rows = child.changes(batch, number)
            if rows is not None:
                cols = [F.col(f"`{a}`").cast(E.SPARK[k]).alias(n) for a, (n, k) in zip(child.kinds, self.kinds.items())]
                rows = rows.select(*cols, "_ts", "_seq", W)
                out = rows if out is None else out.unionByName(rows)
        return out


def flat(alias: str, field: str) -> str:
    return f"{alias}__{field}"


def rewritten(x, replace: Callable[[Col], Col]):
    """An expression with other columns; subqueries are left as they are."""
    if isinstance(x, Col):
        return replace(x)
    if isinstance(x, tuple):
        return tuple(rewritten(y, replace) for y in x)
    if isinstance(x, InQuery):
        return InQuery(rewritten(x.arg, replace), x.query, x.negated)
    if isinstance(x, (Un, Bin, Path, Fn, Agg, Cast, If)):
        return type(x)(**{k: v if k == "at" else rewritten(v, replace) for k, v in ((k, getattr(x, k)) for k in x.__dataclass_fields__)})
    return x


def compiled(view: View, statement) -> Step:
    if isinstance(statement, Union):
        kinds = view.engine.relation(statement).kinds
        both = All(view, [compiled(view, b) for b in statement.branches], kinds)
        if statement.all:
            return both
        keep = Select([Item(Col(c), c) for c in kinds], Source("_u", name="_in"), [])
        distinct = Union([keep, keep], False)
        return Keyed(view, distinct, {"_in": (both, "_u", [Col(c, "_u") for c in kinds])})
    return _select(view, statement)


def _relation(view: View, source: Source) -> Step:
    return Base(view, source.name) if source.query is None else compiled(view, source.query)


def _select(view: View, q: Select) -> Step:
    engine = view.engine
    if q.window or q.emit_changes:
        raise SqlError("WINDOW is for pipelines")
    engine.select(q)  # its diagnostics
    w = engine.scan(q.source)
    for j in q.joins:
        w = engine.join(w, j)
    q = engine._expand(q, w)
    items = [Item(engine._registered(i.expr), i.alias or E.default_name(i.expr, k)) for k, i in enumerate(q.items)]
    conditions = E.conjuncts(q.where)
    nodes = [n for x in (*[i.expr for i in items], *conditions, *(q.group_by or ()), *(q.latest_by or ())) for n in E.walk(x)]
    if any(isinstance(n, (Scalar, Exists)) for n in nodes):
        # One key: what a subquery's value touches isn't known before it is computed.
        children = {n: Base(view, n) for n in sources(q)}
        whole = Select(items, q.source, q.joins, q.where, q.group_by, False, q.latest_by)
        return Keyed(view, whole, {n: (c, n, []) for n, c in children.items()})
    aggregated = q.group_by is not None or any(isinstance(n, Agg) for i in items for n in E.walk(i.expr))
    if q.latest_by is not None and not q.joins and not any(isinstance(c, InQuery) for c in conditions):
        return Latest(view, Select(items, q.source, [], q.where, latest_by=q.latest_by), _relation(view, q.source))

    def located(c: Col) -> tuple[str, str]:
        own = [(a, f) for a, f in w.fields if f.lower() == c.name.lower() and (c.alias is None or a == c.alias)]
        if not own:
            own = [(a, f) for a, f in w.fields if a == f == c.name]  # the element of an UNNEST
        return own[0]

    swap = lambda c: Col(flat(*located(c)), "_d", c.at)
    used = {located(n) for x in (*[i.expr for i in items], *conditions, *(q.group_by or ()), *(q.latest_by or ()), *[x for j in q.joins for x in (j.on, j.unnest) if x is not None]) for n in E.walk(x) if isinstance(n, Col)}

    def side(source: Source) -> Step:
        fields = [(a, f) for a, f in w.fields if a == source.alias and (a, f) in used]
        shown = [Item(Col(f, a), flat(a, f)) for a, f in fields]
        return Linear(view, _relation(view, source), lambda name: Select(shown or [Item(Lit(1), flat(source.alias, "_"))], Source(source.alias, name=name), []))

    step = side(q.source)
    for j in q.joins:
        if j.kind == "unnest":
            keep = [Item(Col(c, "_d"), c) for c in step.kinds] + [Item(Col(j.alias, j.alias), flat(j.alias, j.alias))]
            step = Linear(view, step, lambda name, keep=keep, j=j: Select(keep, Source("_d", name=name), [Join("unnest", None, unnest=rewritten(j.unnest, swap), alias=j.alias)]))
            continue
        other = side(j.source)
        here = set(step.kinds)
        place = lambda c, here=here: Col(flat(*located(c)), "_d" if flat(*located(c)) in here else "_r", c.at)
        on = rewritten(j.on, place) if j.on is not None else None
        left, right = [], []
        for c in E.conjuncts(on):
            sides = [{n.alias for n in E.walk(x) if isinstance(n, Col)} for x in ((c.left, c.right) if isinstance(c, Bin) and c.op == "=" else ())]
            if sides in ([{"_d"}, {"_r"}], [{"_r"}, {"_d"}]):
                a, b = (c.left, c.right) if sides[0] == {"_d"} else (c.right, c.left)
                left.append(a)
                right.append(b)
        shown = [Item(Col(c, "_d"), c) for c in step.kinds] + [Item(Col(c, "_r"), c) for c in other.kinds]
        both = Select(shown, Source("_d", name="_left"), [Join(j.kind, Source("_r", name="_right"), on, alias="_r")])
        step = Keyed(view, both, {"_left": (step, "_d", left), "_right": (other, "_r", right)})
    plain = [rewritten(c, swap) for c in conditions if not isinstance(c, InQuery)]
    for c in (c for c in conditions if isinstance(c, InQuery)):
        inner, arg = compiled(view, c.query), rewritten(c.arg, swap)
        member = next(iter(inner.kinds))
        keep = [Item(Col(x, "_d"), x) for x in step.kinds]
        found = InQuery(arg, Select([Item(Col(member, "_m"), member)], Source("_m", name="_members"), []), c.negated)
        semi = Select(keep, Source("_d", name="_outer"), [], where=found)
        step = Keyed(view, semi, {"_outer": (step, "_d", [arg]), "_members": (inner, "_m", [Col(member, "_m")])})
    where = None
    for c in plain:
        where = c if where is None else Bin("AND", where, c)
    if aggregated or q.latest_by is not None:
        if where is not None:
            keep = [Item(Col(x, "_d"), x) for x in step.kinds]
            step = Linear(view, step, lambda name: Select(keep, Source("_d", name=name), [], where=where))
        last = [Item(rewritten(i.expr, swap), i.alias) for i in items]
        by = tuple(rewritten(g, swap) for g in q.group_by or ())
        if q.latest_by is not None:
            return Latest(view, Select(last, Source("_d", name="_in"), [], latest_by=[rewritten(g, swap) for g in q.latest_by]), step)
        grouped = Select(last, Source("_d", name="_in"), [], group_by=list(by) if q.group_by is not None else None)
        return Keyed(view, grouped, {"_in": (step, "_d", list(by))})
    last = [Item(rewritten(i.expr, swap), i.alias) for i in items]
    return Linear(view, step, lambda name: Select(last, Source("_d", name=name), [], where=where))


class Maintained:
    """A view under maintenance.  ``apply`` takes the changes of base relations and gives those of the view."""

    def __init__(self, engine: "E.Engine", sql: str, path: str | None = None):
        if engine.mode != "table":
            raise SqlError("Views are maintained in table mode")
        self.view = View(engine, path)
        self.step = compiled(self.view, parse(split_sink(sql)[1]))
        self.kinds = self.step.kinds
        self.result = self.view.store()
        self.number = max(self.result.batches, default=-1) + 1
        self.names = sources(parse(split_sink(sql)[1]))

    def apply(self, changes: dict[str, DataFrame], number: int | None = None) -> DataFrame:
        """Net changes: the columns of the view, ``_ts`` and ``_weight``.  ``number``: that of the batch, to apply it again."""
        number = self.number if number is None else number
        self.number = number + 1
        names = [*[f"`{c}`" for c in self.kinds], "_ts"]
        found = self.step.changes({k: v for k, v in changes.items() if v is not None}, number)
        if found is None:
            return self.view.empty(self.kinds).drop("_seq").withColumn(W, F.lit(0).cast("bigint"))
        out = found.withColumn("_seq", F.lit(0).cast("bigint"))
        kept = net(out).withColumn(KEY, F.xxhash64(*names)).checkpoint()
        self.result.append(kept, number)
        return kept.select(*names, W)

    def snapshot(self) -> DataFrame:
        """The rows that the view has now."""
        rows = self.result.read()
        if rows is None:
            return self.view.empty(self.kinds).select(*[f"`{c}`" for c in self.kinds])
        return bag(net(dealt(rows.drop("_b"), self.result.count(), [KEY]))).select(*[f"`{c}`" for c in self.kinds])

    def follow(self, streams: dict[str, DataFrame], checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
        """Applies what streams of base relations hold, one after another, micro-batch by micro-batch."""
        for k, (name, stream) in enumerate(streams.items()):
            first = self.number

            def take(batch: DataFrame, n: int, name=name, first=first) -> None:
                out = self.apply({name: batch}, first + n)
                if sink is not None:
                    sink(out, first + n)

            query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{k}-{name}").trigger(availableNow=True).start()
            query.awaitTermination()
