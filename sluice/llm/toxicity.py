"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of the labelled rows, ``EXAMPLES`` per class, taken in
the order of a seeded hash.  Terms are words, and the space is that of all words of the
examples: none is left out, however rare.  Document frequencies for the TF-IDF weights
are counted over all documents.  A weight is TF-IDF times the term's association with the labels, ``chi / (chi +
HALF)`` by its chi-squared: plain TF-IDF lets the hundreds of neutral words of a long text
drown the few that decide (README has the figures of both).

The ``NEIGHBOURS`` nearest examples by cosine are found exactly with a block-max
inverted index: examples stand in blocks, a term's postings carry the largest
weight in each block, the blocks with the largest bounds are scored first, and of
the others only those whose bound reaches the worst neighbour so far.  Terms in over one of ``COMMON``
examples stand in columns instead, which are multiplied for ``BATCH`` texts at a time; a block's bound starts with the
largest of its products with them.  Cosines are compared to 12 decimals.  Votes are
weighted by distance and by how the classes were sampled.  They are calibrated by isotonic regression on the votes of
examples that took no part: for each of ``PARTS`` parts of the examples the associations and the index come from the others.
The neighbours are the evidence.

Defined results: null texts are empty; labels that are null or other than 0 and 1 are
not used; of several labels of a document the largest counts; without examples
of both classes every score is that of the examples' one class (0 without any); ties between
neighbours go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Examples per class: the bound of what is learned from.
EXAMPLES = 2048
#: The chi-squared at which a term has half its weight; chance gives 1 on average.
HALF = 20.0
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that are scored before the others are held against a bound.
EAGER = 6
#: Terms in more than one of so many examples are columns; texts that are multiplied with them at a time.
COMMON = 16
BATCH = 64
#: Parts of the examples in calibration.
PARTS = 4
#: Rows in a partition of a result: Hadoop starts a ``chmod`` for each file that is written of it (``common.gathered``).
PER_FILE = 1 << 16
SEED = 7
FOLDS = 5
WORD = re.compile(r"\w+")
EVIDENCE = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64())])))])


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Terms:
    """Numbers of the terms in a text and how often they stand there."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(words_of(text))
        own = counts.keys() & self.number.keys()
        numbers = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
        often = np.fromiter(map(counts.__getitem__, own), np.int64, len(own))
        order = np.argsort(numbers)
        return numbers[order], often[order]


def association(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Of each term ``chi / (chi + HALF)``; ``rows`` and ``terms`` say which term stands in which example."""
    n, ones = len(labels), int(labels.sum())
    zeros = n - ones
    a = np.bincount(terms, labels[rows], n_terms)
    b = np.bincount(terms, 1 - labels[rows], n_terms)
    odd = a * (zeros - b) - b * (ones - a)
    under = (a + b) * (n - a - b) * ones * zeros
    chi = np.divide(odd * odd * n, under, out=np.zeros(n_terms), where=under > 0)
    return chi / (chi + HALF)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class BlockMaxIndex:
    """Exact top-k inner products over sparse vectors, given as row, term and positive weight of each entry."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int, block: int = BLOCK):
        keep = weights > 0
        rows, terms, weights = rows[keep], terms[keep], weights[keep]
        # Vectors with the same strongest term stand together, which tightens the bounds.
        order = np.lexsort((terms, -weights, rows))
        first = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0]) if len(rows) else np.zeros(0, np.int64)
        strongest, height = np.full(n_rows, n_terms), np.zeros(n_rows)
        strongest[rows[order][first]], height[rows[order][first]] = terms[order][first], weights[order][first]
        self.numbers = np.lexsort((np.arange(n_rows), -height, strongest))
        place = np.empty(n_rows, np.int64)
        place[self.numbers] = np.arange(n_rows)
        self.n_rows, self.blocks = n_rows, -(-n_rows // block)
        at = place[rows]
        # Common terms in columns; the height of a column is padded to whole blocks.
        self.height = self.blocks * block
        often = np.bincount(terms, minlength=n_terms) * COMMON > n_rows
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.columns = np.zeros((self.height, int(often.sum())))
        common = often[terms]
        self.columns[at[common], self.column[terms[common]]] = weights[common]
        at, terms, weights = at[~common], terms[~common], weights[~common]
        order = np.lexsort((at, terms))
        self.at, self.weight = at[order].astype(np.int32), weights[order]
        terms, blocks = terms[order], self.at // block
        # Runs of postings of one term in one block.
        start = np.flatnonzero(np.r_[True, (np.diff(terms) != 0) | (np.diff(blocks) != 0)]) if len(terms) else np.zeros(0, np.int64)
        self.start, self.length = start.astype(np.int32), np.diff(np.r_[start, len(terms)]).astype(np.int32)
        self.block = blocks[start].astype(np.int16)
        self.most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        # A term's runs, by term.
        self.runs = np.searchsorted(terms[start], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights): ``(product, number)`` of the k largest positive products, largest first, ties to the smaller number."""
        out = []
        for first in range(0, len(queries), BATCH):
            some = queries[first : first + BATCH]
            dense = np.zeros((len(some), self.columns.shape[1]))
            for n, (terms, weights) in enumerate(some):
                column = self.column[terms]
                dense[n, column[column >= 0]] = weights[column >= 0]
            products = dense @ self.columns.T
            for own, (terms, weights) in zip(products, some):
                rare = self.column[terms] < 0
                out.append(self._nearest(own, terms[rare], weights[rare], k))
        return out

    def _nearest(self, products: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``products``: those of the common terms."""
        if not self.n_rows:
            return []
        counts = self.runs[terms + 1] - self.runs[terms]
        runs, query = ranges(self.runs[terms], counts), np.repeat(weights, counts)
        blocks = self.block[runs]
        bound = products.reshape(self.blocks, -1).max(axis=1)
        bound += np.bincount(blocks, query * self.most[runs], self.blocks)

        def score(which: np.ndarray) -> None:
            mine = which[blocks]
            own, lengths = runs[mine], self.length[runs[mine]]
            entries = ranges(self.start[own], lengths)
            products[:] += np.bincount(self.at[entries], np.repeat(query[mine], lengths) * self.weight[entries], self.height)

        def worst() -> float:
            """The k-th product so far, or less: blocks that aren't scored have no more than theirs."""
            return np.partition(products, -k)[-k] if len(products) >= k else 0.0

        eager = np.zeros(self.blocks, bool)
        eager[np.argsort(-bound, kind="stable")[:EAGER]] = True
        score(eager)
        rest = ~eager & (bound > 0) & (bound >= worst() - 1e-9)
        if rest.any():
            score(rest)
        found = np.flatnonzero((products >= worst() - 1e-11) & (products > 0))
        numbers, near = self.numbers[found], products[found].round(12)
        best = np.lexsort((numbers, -near))[:k]
        return list(zip(near[best].tolist(), numbers[best].tolist()))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and values of a rising step function."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # low x, high x, weighted sum, weight
    for i in order.tolist():
        if pools and pools[-1][1] == x[i]:
            pools[-1][2] += w[i] * y[i]
            pools[-1][3] += w[i]
        else:
            pools.append([x[i], x[i], w[i] * y[i], w[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, s, n = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = high, pools[-1][2] + s, pools[-1][3] + n
    knots = np.array([v for p in pools for v in (p[0], p[1])])
    values = np.array([v for p in pools for v in (p[2] / p[3],) * 2])
    return knots, values


class Neighbours:
    """Votes of the nearest among some examples."""

    def __init__(self, idf: np.ndarray, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.labels, self.weights = labels.astype(float), weights
        total = weights.sum()
        self.prior = float((weights * labels).sum() / total) if total else 0.0
        self.factor = idf * association(rows, terms, labels, len(idf)) if len(labels) else np.zeros(len(idf))
        size = (1 + np.log(counts)) * self.factor[terms]
        norm = np.sqrt(np.bincount(rows, size * size, len(labels)))
        self.index = BlockMaxIndex(rows, terms, np.divide(size, norm[rows], out=np.zeros(len(size)), where=size > 0), len(labels), len(idf))

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[float, int]]]:
        """For each text, by its terms and their counts."""
        queries = []
        for terms, counts in texts:
            size = (1 + np.log(counts)) * self.factor[terms]
            some = size > 0
            size = size[some]
            queries.append((terms[some], size / np.sqrt((size * size).sum()) if len(size) else size))
        return self.index.nearest(queries, NEIGHBOURS)

    def vote(self, found: list[tuple[float, int]]) -> float:
        total, agree = 1e-3, 1e-3 * self.prior
        for product, n in found:
            w = self.weights[n] / (1e-2 + max(0.0, 1.0 - product))
            total += w
            agree += w * self.labels[n]
        return agree / total


class Model:
    def __init__(self, terms: list[str], idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, starts: np.ndarray, codes: np.ndarray, counts: np.ndarray, rows_of: dict[int, float], rows: int):
        """Examples in the order of their ids; ``codes`` and ``counts`` of example i stand from ``starts[i]`` to ``starts[i + 1]``.
        ``rows_of``: rows of the table per example of each class.  ``rows``: of the table."""
        self.terms, self.ids, self.rows = Terms(terms), ids, rows
        lengths = np.diff(starts)
        weights = np.array([rows_of[y] for y in labels.tolist()], dtype=float)
        at = np.repeat(np.arange(len(ids)), lengths)
        part = np.array([zlib.crc32(str(i).encode()) // FOLDS % PARTS for i in ids.tolist()])
        votes = np.zeros(len(ids))
        for p in range(PARTS):
            others = part != p
            if not others.any():
                continue
            number = np.cumsum(others) - 1
            theirs = others[at]
            model = Neighbours(idf, number[at[theirs]], codes[theirs], counts[theirs], labels[others], weights[others])
            own = np.flatnonzero(~others)
            found = model.nearest([(codes[starts[i] : starts[i + 1]], counts[starts[i] : starts[i + 1]]) for i in own.tolist()])
            votes[own] = [model.vote(x) for x in found]
            del model, found  # one index at a time
        self.knots, self.values = isotonic(votes, labels, weights) if len(ids) else (np.array([0.0, 1.0]), np.array([0.0, 0.0]))
        self.neighbours = Neighbours(idf, at, codes, counts, labels, weights)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """Score and nearest examples of each text."""
        out = []
        for found in self.neighbours.nearest([self.terms.count(t) for t in texts]):
            vote = float(np.interp(self.neighbours.vote(found), self.knots, self.values))
            out.append((min(1.0, max(0.0, vote)), [(min(1.0, p), int(self.ids[n])) for p, n in found]))
        return out

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        return self.scores([text])[0]


def held_out(key: Column, folds: int = FOLDS) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == 0


def _counted(examples: DataFrame) -> pa.Table:
    """``id, y, terms, counts`` of the examples, by id."""

    def run(batches):
        for batch in batches:
            own = [Counter(words_of(t)) for t in batch.column(2).to_pylist()]
            arrays = [pa.array([list(c.keys()) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "y", "terms", "counts"])

    return examples.select("id", "y", "text").mapInArrow(run, "id long, y int, terms array<string>, counts array<long>").toArrow().sort_by("id")


def _document_frequencies(docs: DataFrame, text_col: str, terms: list[str]) -> tuple[np.ndarray, int]:
    """Over all rows: in how many each term stands, and the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        number, found, rows = {t: i for i, t in enumerate(shared.value)}, Counter(), 0
        known = set(number)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                found.update(set(words_of(text)) & known)
        numbers, counts = [*(number[t] for t in found), -1], [*found.values(), rows]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(counts, pa.int64())], names=["term", "n"])

    slim = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = slim.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    numbers, counts = (counted.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(len(terms))
    df[numbers[numbers >= 0]] = counts[numbers >= 0]
    return df, int(counts[numbers < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS) -> Model:
    """Learns from rows that aren't held out.  What comes to the driver are the words of at most
    EXAMPLES texts a class; document frequencies are summed over all of ``docs``."""
    spark = docs.sparkSession
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter("id is not null and y in (0, 1)")
        .filter(~held_out(F.col("id"), folds))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64(F.lit(SEED), "id")
    sample = [known.filter(F.col("y") == y).orderBy(order, "id").limit(EXAMPLES) for y in (0, 1)]
    picked = spark.createDataFrame([(r["id"], r["y"]) for s in sample for r in s.collect()], "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.first("y").alias("y"), F.max("text").alias("text"))
    found = _counted(staged(joined, "examples"))
    words = found.column("terms").combine_chunks()
    coded = pa.array(words.flatten()).dictionary_encode() if len(words) else pa.array([], pa.string()).dictionary_encode()
    terms = coded.dictionary.to_pylist()
    df, rows = _document_frequencies(docs, text_col, terms)
    idf = np.log((1 + rows) / (1 + df)) + 1
    y = found.column("y").to_numpy().astype(np.int64)
    starts = np.r_[0, np.cumsum([len(x) for x in words])].astype(np.int64)
    counts = found.column("counts").combine_chunks()
    counts = counts.flatten().to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    taken = Counter(y.tolist())
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # The terms of a text in the order of their numbers, as the texts to be scored have them.
    sort = np.lexsort((codes, np.repeat(np.arange(len(y)), np.diff(starts))))
    return Model(terms, idf, found.column("id").to_numpy(), y, starts, codes[sort], counts[sort], {k: sizes.get(k, 0) / taken[k] for k in taken}, rows)


def _judged(model: Model, texts: pa.Array) -> list[pa.Array]:
    """``score`` and ``evidence`` of each text."""
    # A few texts at a time: what is known of all of them at once are numbers in compact arrays.
    scores, ends, examples, cosines = array("d"), array("i", [0]), array("q"), array("d")
    for at in range(0, len(texts), BATCH):
        for score, found in model.scores(texts.slice(at, BATCH).to_pylist()):
            scores.append(score)
            cosines.extend(p for p, _ in found)
            examples.extend(i for _, i in found)
            ends.append(len(examples))
    near = pa.StructArray.from_arrays([pa.array(np.array(examples)), pa.array(np.array(cosines))], fields=list(EVIDENCE.field("evidence").type.value_type))
    return [pa.array(np.array(scores)), pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), near)]


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` packed as ``record``, with ``score`` and ``evidence`` (nearest examples and their cosines)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, evidence: array<struct<example: long, cosine: double>>>")
    def judge(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_judged(shared.value, texts), names=["score", "evidence"])

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"))
    judged = packed.withColumn("j", judge(F.col("record").getField(text_col).cast("string")))
    return judged.select("record", "j.score", "j.evidence")


def scored_ids(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``scored``, with only the id of each row.  No text waits in the JVM for its score, and the
    rows come in a partition for each PER_FILE rows, however many the input has."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(shared.value, batch.column(1))], names=[id_col, "score", "evidence"])

    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, score double, evidence array<struct<example: long, cosine: double>>"
    return slim.mapInArrow(run, kind).repartition(1 + model.rows // PER_FILE)


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, as they are."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") < at).select("record.*")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = scored_ids(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
