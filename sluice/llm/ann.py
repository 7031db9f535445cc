"""Nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors) on the driver; every
row is then put into its leaf.  A query walks the tree best bin first: a priority
queue holds nodes by the product that the best of their rows can be expected to have, that is query times centroid
and ``REACH`` deviations of the node's spread in the query's direction; the leaves come
out in the order in which they are to be visited.  How many are visited is
calibrated: for a bounded set of queries the true neighbours over all rows are
found by brute force, and visits widen until their recall reaches ``TARGET``.

Neighbouring leaves stand in groups of about ``CHUNK`` vectors.  A query goes to a group once, with the leaves that
it visits there, and meets the vectors of just these leaves; a group with more vectors or queries than a chunk is dealt to
several tasks, so neither a full leaf nor a popular one is held by one.  A query brings along the product that its ``k + 1``
best reach among ``TASTED`` sampled vectors of the leaves that it visits first: what lies below can't be among the nearest that it finds.  The best of each group are cut to the best of all
by ranks, partly before they are shuffled.  Equal vectors of the whole table
stand in one row with the smallest ids that can be among a query's nearest, before
anything is sampled, calibrated or searched, and equal queries are searched once.  Scores are inner products of the original
vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; nor do those of another length than most (of equally
many the shorter), of which a warning tells the number; null ids take no part; ties go to the smaller id; rows that repeat id and
vector are one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, staged, table

K = 20
SAMPLE = 32768
BRANCH = 8
#: Sampled vectors of a leaf, and deviations by which the best row of a node is expected to lie above its mean.
LEAF = 24
REACH = 2.75
#: Queries that calibrate, and the recall that they must reach.
CALIBRATION = 256
TARGET = 0.95
#: Vectors, and queries, in a chunk; candidates of a task before they are cut to the best.
CHUNK = 2048
QUERIES = 8192
PENDING = 1 << 18
TASTED = 1024
SEED = 17


class Tree:
    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = SEED):
        self.centroids: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        self.leaf_of: list[int] = [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            groups = self._split(rows, branch, rng) if len(rows) > leaf else []
            if len(groups) < 2:
                self.leaf_of[node] = self.leaves
                self.leaves += 1
                continue
            for centre, members in groups:
                self.children[node].append(len(self.centroids))
                todo.append((len(self.centroids), members))
                self.centroids.append(centre)
                self.children.append([])
                self.leaf_of.append(-1)
        self.matrix = np.stack(self.centroids)
        self.spread = np.zeros(len(self.centroids))
        todo = [(0, sample)]
        while todo:
            node, rows = todo.pop()
            self.spread[node] = np.sqrt(((rows - self.matrix[node]) ** 2).sum(axis=1).mean() / rows.shape[1])
            if self.children[node]:
                near = self._nearest(rows, self.matrix[self.children[node]])
                todo += [(child, rows[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any()]

    @staticmethod
    def _split(rows: np.ndarray, branch: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = np.unique(rows[rng.choice(len(rows), min(branch, len(rows)), replace=False)], axis=0)
        for _ in range(8):
            near = Tree._nearest(rows, centres)
            centres = np.stack([rows[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        near = Tree._nearest(rows, centres)
        return [(centres[c], rows[near == c]) for c in range(len(centres)) if (near == c).any()]

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmax(rows @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child all the way down."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = self.leaf_of[node]
                continue
            near = self._nearest(rows[at], self.matrix[self.children[node]])
            todo += [(child, at[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any()]
        return out

    def best_bins(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves of a best-bin-first walk."""
        score = self.matrix @ query + REACH * np.sqrt(query @ query) * self.spread
        heap, out = [(0.0, 0)], []
        while heap and len(out) < visits:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-float(score[child]), child))
            else:
                out.append(self.leaf_of[node])
        return out


def _matrix(column, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    x = F.col("vector")
    good = (
        F.col("id").isNotNull()
        & (F.size(x) > 0)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    found = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(good)
    sizes = found.groupBy(F.size("vector").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = first[0]["d"] if first else 0
    odd = sizes.filter(F.col("d") != dimension).agg(F.sum("count")).first()[0]
    if odd:
        warnings.warn(f"{odd} vectors have another length than {dimension} and take no part", stacklevel=3)
    return found.filter(F.size("vector") == dimension), dimension


def _distinct(rows: DataFrame, dimension: int, kind: str, k: int) -> DataFrame:
    """``vector, ids``: a row per vector of the whole table with its k + 1 smallest ids.
    Batches merge what they repeat, so a common vector sends its group a short list per batch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column(1), dimension), batch.column(0).to_numpy()
            x += 0.0  # -0.0 and 0.0 are equal
            order = np.argsort(ids, kind="stable")
            groups: dict[bytes, list[int]] = {}
            for at in order.tolist():
                groups.setdefault(x[at].tobytes(), []).append(at)
            first = np.array([g[0] for g in groups.values()])
            own = [list(dict.fromkeys(ids[g].tolist()))[: k + 1] for g in groups.values()]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(first)), pa.array(own, pa.list_(pa.int64()))], names=["vector", "ids"])

    merged = rows.select("id", "vector").mapInArrow(run, f"vector {kind}, ids array<long>").groupBy("vector").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return merged.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids"))


def _indexed(rows: DataFrame, tree: Tree, dimension: int, kind: str) -> DataFrame:
    """``leaf, vector, ids``."""
    box = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaves = box.value.assign(_matrix(batch.column(0), dimension))
                yield pa.RecordBatch.from_arrays([pa.array(leaves), batch.column(0), batch.column(1)], names=["leaf", "vector", "ids"])

    return rows.select("vector", "ids").mapInArrow(run, f"leaf int, vector {kind}, ids array<long>")


def _calibrated(index: DataFrame, queries: list[tuple[int, np.ndarray]], tree: Tree, dimension: int, k: int, target: float) -> int:
    """The least number of leaves at which the queries' recall against brute force over all rows reaches ``target``."""
    if not queries:
        return 1
    numbers, matrix = np.array([i for i, _ in queries]), np.stack([q for _, q in queries])

    def run(batches):
        best: list[list[tuple[float, int, int]]] = [[] for _ in numbers]
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(0).to_numpy()
            scores = matrix @ _matrix(batch.column(1), dimension).T
            ids = batch.column(2).to_pylist()
            for n in range(len(numbers)):
                at = np.argpartition(-scores[n], min(k, scores.shape[1] - 1))[: k + 1]
                rows = [(-float(scores[n, a]), i, int(leaf[a])) for a in at for i in ids[a] if i != numbers[n]]
                best[n] = sorted(best[n] + rows)[:k]
        rows = [(n, *x) for n, own in enumerate(best) for x in own]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], names=["n", "s", "id", "leaf"])

    nearest = (
        index.select("leaf", "vector", "ids")
        .mapInArrow(run, "n int, s double, id long, leaf int")
        .groupBy("n")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("s", "id", "leaf"))), 1, k).alias("best"))
        .collect()
    )
    ranks, wanted = [], 0
    for row in nearest:
        place = {leaf: p for p, leaf in enumerate(tree.best_bins(matrix[row["n"]], tree.leaves))}
        ranks += [place[b["leaf"]] for b in row["best"]]
        wanted += len(row["best"])
    if not ranks:
        return 1
    return int(np.sort(ranks)[min(wanted - 1, int(np.ceil(target * wanted)) - 1)]) + 1


def _cut(q: np.ndarray, score: np.ndarray, k: int, least_of: np.ndarray) -> np.ndarray:
    """Which candidates are among the k best of their query; what rounding may have put just below stays.
    ``least_of`` gets the least product that can still be among them, by query."""
    order = np.lexsort((-score, q))
    q, score = q[order], score[order]
    start = np.flatnonzero(np.r_[True, np.diff(q) != 0])
    length = np.diff(np.r_[start, len(q)])
    least = score[start + np.minimum(length, k) - 1]
    least = np.where(length >= k, least - 1e-9 * (1 + np.abs(least)), -np.inf)
    least_of[q[start]] = np.maximum(least_of[q[start]], least)
    return order[score >= np.repeat(least, length)]


class Taster:
    """The sampled vectors by leaf: they stand in the table, so their products bound those of a query's nearest."""

    def __init__(self, tree: Tree, sample: np.ndarray):
        leaf = tree.assign(sample)
        order = np.argsort(leaf, kind="stable")
        self.rows = sample[order]
        self.edge = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))

    def floor(self, query: np.ndarray, leaves: list[int], k: int) -> float:
        """A product that ``k + 1`` distinct vectors in ``leaves`` reach, less what rounding may do."""
        parts, n = [], 0
        for leaf in leaves:
            parts.append(self.rows[self.edge[leaf] : self.edge[leaf + 1]])
            n += len(parts[-1])
            if n >= TASTED:
                break
        if n <= k:
            return -np.inf
        least = float(np.partition(np.concatenate(parts) @ query, -(k + 1))[-(k + 1)])
        return least - 1e-9 * (1 + abs(least))


def _search(dimension: int, k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out_ids: list[int] = []
        out_best: list[list[dict]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("leaf")
            leaf = left.column("leaf").to_numpy()
            x = _matrix(left.column("vector").combine_chunks(), dimension)
            queries = _matrix(right.column("vector").combine_chunks(), dimension)
            asked = right.column("leaves").combine_chunks()
            who = np.repeat(np.arange(len(queries)), asked.value_lengths().to_numpy(zero_copy_only=False))
            wanted = asked.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(wanted, kind="stable")
            who, wanted = who[order], wanted[order]
            least = right.column("floor").to_numpy().copy()
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            pending = 0

            def cut() -> None:
                nonlocal held, pending
                q, row, score = (np.concatenate(c) for c in zip(*held))
                best = _cut(q, score, k + 1, least)
                held, pending = [(q[best], row[best], score[best])], 0

            starts = np.flatnonzero(np.r_[True, np.diff(leaf) != 0])
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
                own = who[np.searchsorted(wanted, leaf[low]) : np.searchsorted(wanted, leaf[low], "right")]
                if not len(own):
                    continue
                score = queries[own] @ x[low:high].T
                at, column = np.nonzero(score >= least[own][:, None])
                held.append((own[at], low + column, score[at, column]))
                pending += len(at)
                if pending > PENDING:
                    cut()
            if held:
                cut()
                q, row, _ = held[0]
                lists, keys = left.column("ids").to_pylist(), right.column("qid").to_pylist()
                # Products are rounded differently within a matrix product: what is near the border is scored anew alike.
                exact = np.concatenate([(x[row[a : a + QUERIES]] * queries[q[a : a + QUERIES]]).sum(axis=1) for a in range(0, len(q), QUERIES)])
                ids = np.array([i for r in row.tolist() for i in lists[r]])
                repeated = np.repeat(np.arange(len(row)), [len(lists[r]) for r in row.tolist()])
                edge = np.searchsorted(q[repeated], np.arange(len(queries) + 1))
                for n in np.unique(q).tolist():
                    mine, score = ids[edge[n] : edge[n + 1]], exact[repeated[edge[n] : edge[n + 1]]]
                    top = _top(score, mine, k + 1)
                    out_ids.append(keys[n])
                    out_best.append([{"s": -float(score[t]), "id": int(mine[t])} for t in top])
        kind = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
        return pa.table({"qid": pa.array(out_ids, pa.int64()), "best": pa.array(out_best, kind)})

    return run


def grouped_leaves(sizes: dict[int, int], chunk: int = CHUNK) -> tuple[dict[int, int], dict[int, int]]:
    """Leaf to group, and group to the chunks of its vectors: runs of leaves of about ``chunk`` vectors."""
    group_of: dict[int, int] = {}
    held: dict[int, int] = {}
    group = 0
    for leaf in sorted(sizes):
        if held.get(group) and held[group] + sizes[leaf] > chunk:
            group += 1
        group_of[leaf] = group
        held[group] = held.get(group, 0) + sizes[leaf]
    return group_of, {g: -(-n // chunk) for g, n in held.items()}


def nearest_neighbours(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, target: float = TARGET
) -> DataFrame:
    """``query_id, rank, vec_id, score``.  ``is_query``: from the id column to a condition."""
    spark = vectors.sparkSession
    valid, dimension = _valid(vectors, id_col, vector_col)
    kind = vectors.schema[vector_col].dataType.simpleString()
    if not dimension:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    bound = max(LEAF, min(SAMPLE, (1 << 25) // dimension))
    held = staged(_distinct(valid, dimension, kind, k), "vectors")
    hashed = (F.xxhash64(F.lit(SEED), x) for x in (F.col("ids")[0], "vector"))
    rows = held.orderBy(*hashed).limit(bound).select("vector").toArrow().column(0).combine_chunks()
    sample = _matrix(rows, dimension)
    tree = Tree(sample)
    taster = Taster(tree, sample)
    index = staged(_indexed(held, tree, dimension, kind), "ann")

    queries = valid.filter(is_query(F.col("id")))
    distinct = cut(queries.groupBy("vector").agg(F.min("id").alias("qid")))
    picked = distinct.orderBy(F.xxhash64(F.lit(SEED + 1), "qid"), "qid").limit(CALIBRATION).collect()
    visits = _calibrated(index, [(r["qid"], np.array(r["vector"], dtype=np.float64)) for r in picked], tree, dimension, k, target)

    # A number for each leaf and each group of leaves: the tree bounds them.
    group_of, parts_of = grouped_leaves({r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()})
    box = spark.sparkContext.broadcast((tree, group_of, taster))

    def walk(batches):
        tree, group_of, taster = box.value
        for batch in batches:
            own: list[int] = []
            groups, leaves = [], []
            floors = np.zeros(batch.num_rows)
            for n, x in enumerate(_matrix(batch.column(1), dimension) if batch.num_rows else ()):
                met: dict[int, list[int]] = {}
                found = tree.best_bins(x, visits)
                floors[n] = taster.floor(x, found, k)
                for leaf in found:
                    if leaf in group_of:
                        met.setdefault(group_of[leaf], []).append(leaf)
                own += [n] * len(met)
                groups += met
                leaves += met.values()
            taken = pa.array(own, pa.int64())
            arrays = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(floors).take(taken), pa.array(groups, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["qid", "vector", "floor", "group", "leaves"])

    spread = distinct.select("qid", "vector").repartition(shuffle_partitions(spark), "qid")
    stops = staged(spread.mapInArrow(walk, f"qid long, vector {kind}, floor double, group int, leaves array<int>"), "visits")
    turns_of = {r["group"]: -(-r["count"] // QUERIES) for r in stops.groupBy("group").count().collect()}
    number = lambda of, c, least=1: F.coalesce(F.get(F.array(*[F.lit(of.get(g, least)) for g in range(max(parts_of, default=0) + 1)]), F.col(c)), F.lit(least))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    grouping = spark.createDataFrame(list(group_of.items()), "leaf int, group int")
    left = (
        index.join(F.broadcast(grouping), "leaf")
        .filter(number(turns_of, "group", 0) > 0)
        .withColumn("part", F.pmod(F.xxhash64("vector"), number(parts_of, "group")).cast("int"))
        .select("group", "part", each(number(turns_of, "group")).alias("turn"), "leaf", "vector", "ids")
    )
    right = stops.withColumn("turn", F.pmod(F.xxhash64("qid"), number(turns_of, "group")).cast("int")).select(
        "group", each(number(parts_of, "group")).alias("part"), "turn", "vector", "qid", "floor", "leaves"
    )
    keys = ("group", "part", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(dimension, k), "qid long, best array<struct<s: double, id: long>>")
    # A vector stands in one chunk, so the chunks' neighbours are different rows.  Ranks hold k + 1 rows of a query at a time.
    ranked = found.select("qid", F.explode("best").alias("b")).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("b.s", "b.id")))
    merged = ranked.filter(F.col("n") <= k + 1).groupBy("qid").agg(F.sort_array(F.collect_list("b")).alias("all"))
    best = cut(merged.select("qid", F.slice("all", 1, k + 1).alias("best")))
    named = cut(distinct.select("vector", "qid"))
    asked_by = queries.select("id", "vector").join(named, "vector").select("id", "qid").distinct()
    own = asked_by.join(best, "qid").select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k)).alias("rank", "b"),
    )
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
