"""SimHash near-duplicates with a pigeonring filter.

A text's fingerprint has a bit set where over half of the XXH64 hashes of its
shingles have it.  Two fingerprints of 64 bits link at ``BITS`` (3) differing bits
or fewer.  Cut into a ring of four segments of 16 bits, any linked pair has a
start from which every chain of consecutive segments keeps within its share of
the budget: no difference in the first segment, at most one in the first two, at
most two in three, three in all.  The first two conditions become keys: a
fingerprint stands under its two segments, and under each form of them with
one set bit of the second cleared, so of a pair that differs there one stands
under the other's key.  The chain conditions of three and four segments prune what
meets under a key before the Hamming distance is computed.  This loses no link.

Equal fingerprints are one node.  A task holds at most ``HEAVY`` records of a key; those
of a fuller key are dealt out anew, under the key and one of four parts of the bits that it
leaves open: of two fingerprints that link one part at least is equal.  After ``LEVELS``
such steps 18 bits are open, so a key has at most 2**18 fingerprints.
A task unites the links it finds and passes on one edge per linked fingerprint, not all
pairs (at most ``UNITED`` fingerprints at a time); components are then closed over tasks.

Defined results: null counts as empty; texts without words have fingerprint zero
and link like any other; texts of fewer words than a shingle are one shingle;
null ids never name a component that has another id; repeated rows share all.  Of a
component one row stays: that with the smallest id (null ids last), then the smallest
fingerprint, then the smallest digest of its text, then any of rows equal in all that.
Ids may repeat: components are told apart by fingerprint, so no text goes that is in none with another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, gathered, table
from .graph import Forest, connected_components

WORDS = 3
SEED = 42
BITS = 3
SEGMENTS = 4
WIDTH = 64 // SEGMENTS
#: Shingles hashed at a time, so that long texts take bounded memory.
CHUNK = 1 << 16
#: Records of a key that a task compares, and how often fuller keys are dealt out.
HEAVY = 4096
LEVELS = 2
#: Fingerprints that a task unites before it passes on what it has.
UNITED = 200_000
RECORDS = "start byte, key long, fp long, exact boolean"


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    # bytes.lower and bytes.split know ASCII only: A-Z, and 0x20 and 0x09-0x0D.
    tokens = data.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    n, digest, join = len(tokens) - words + 1, xxhash.xxh64_intdigest, b" ".join
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = tokens[at : min(at + CHUNK, n) + words - 1]
        hashes = np.fromiter((digest(join(s), seed) for s in zip(*(part[k:] for k in range(words)))), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, extra: str | None = None) -> DataFrame:
    """``id, fp``, the fingerprint as a signed long, and the string column ``extra`` on demand."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t or b"", words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *([extra] if extra else [])])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), *([F.col(extra)] if extra else []))
    return slim.mapInArrow(run, "id long, fp long" + (f", `{extra}` string" if extra else ""))


def segment(values: np.ndarray, k: int) -> np.ndarray:
    return (values >> np.uint64(WIDTH * (k % SEGMENTS))) & np.uint64((1 << WIDTH) - 1)


def _records(starts: np.ndarray, keys: np.ndarray, prints: np.ndarray, exact: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(starts.astype(np.int8)), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(prints.view(np.int64)), pa.array(exact)]
    return pa.RecordBatch.from_arrays(arrays, names=["start", "key", "fp", "exact"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    starts, keys, prints, exact = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:4])
    return [starts.astype(np.int8), keys.view(np.uint64), prints.view(np.uint64), exact.astype(bool)]


def _chain_keys(batches):
    """Keys of the first two segments of each ring start: as they are, and with one set bit of the second cleared."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        out = []
        for start in range(SEGMENTS):
            second = segment(prints, start + 1)
            key = (segment(prints, start) << np.uint64(WIDTH)) | second
            out.append((np.full(len(prints), start), key, prints, np.ones(len(prints), bool)))
            for bit in range(WIDTH):
                mask = np.uint64(1 << bit)
                has = (second & mask) != 0
                out.append((np.full(int(has.sum()), start), key[has] ^ mask, prints[has], np.zeros(int(has.sum()), bool)))
        yield _records(*(np.concatenate(x) for x in zip(*out)))


def _part_keys(level: int):
    """Records under their key and each of four parts of the bits that are open at this level.

    The open bits are the two segments that no key of this start covers, less one part for each level before."""

    def run(batches):
        for batch in batches:
            starts, keys, prints, exact = _columns(batch)
            rest = np.zeros(len(prints), np.uint64)
            for start in range(SEGMENTS):
                own = starts % SEGMENTS == start
                rest[own] = segment(prints[own], start + 2) | (segment(prints[own], start + 3) << np.uint64(WIDTH))
            width = 2 * WIDTH
            # The number of a start also says which parts the key holds.
            taken = starts.astype(np.int64) // SEGMENTS
            for _ in range(level):
                part, size = taken % 4, width // 4
                low = (part * size).astype(np.uint64)
                rest = (rest & ((np.uint64(1) << low) - np.uint64(1))) | ((rest >> (low + np.uint64(size))) << low)
                taken, width = taken // 4, width - size
            size = width // 4
            for part in range(4):
                value = (rest >> np.uint64(part * size)) & np.uint64((1 << size) - 1)
                marked = starts.astype(np.int64) + SEGMENTS * part * 4**level
                yield _records(marked, (keys << np.uint64(size)) | value, prints, exact)

    return run


def within_chain(a: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of ``others`` keep the chains of three and four segments from ``start`` within budget."""
    diff = others ^ a
    spent = np.zeros(len(others), dtype=np.int64)
    good = np.ones(len(others), bool)
    for length in range(1, SEGMENTS + 1):
        spent += np.bitwise_count(segment(diff, start + length - 1))
        good &= spent <= BITS * length // SEGMENTS
    return good & (np.bitwise_count(diff) <= BITS)


def _link(forest: Forest, start: int, prints: np.ndarray, exact: np.ndarray) -> None:
    mine = prints[exact]
    if not len(mine) or len(prints) < 2:
        return
    lowered = prints[~exact]
    for i, a in enumerate(mine):
        others = np.concatenate([mine[i + 1 :], lowered])
        for b in others[within_chain(a, others, start)].tolist():
            forest.unite(int(a), b)


LINKED = f"a long, b long, {RECORDS}"


def _edges(forest: Forest) -> pa.RecordBatch:
    pairs = np.array([(x, r) for x in list(forest.parent) if (r := forest.find(x)) != x], dtype=np.uint64).reshape(-1, 2).view(np.int64)
    none = [pa.nulls(len(pairs), t) for t in (pa.int8(), pa.int64(), pa.int64(), pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), *none], names=["a", "b", "start", "key", "fp", "exact"])


def _put_off(records: list[np.ndarray]) -> pa.RecordBatch:
    own = _records(*records)
    return pa.RecordBatch.from_arrays([pa.nulls(own.num_rows, pa.int64()), pa.nulls(own.num_rows, pa.int64()), *own.columns], names=["a", "b", *own.schema.names])


def _links(heavy: int | None):
    """Reads records sorted by start and key; gives an edge for each fingerprint that links here, and back the records
    of keys that have more than ``heavy``."""

    def run(batches):
        forest = Forest()
        held = [np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        full = None  # the key whose records are put off
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _columns(batch)
            records = [np.concatenate(x) for x in zip(held, new)] if len(held[0]) else new
            starts, keys = records[:2]
            edge = np.flatnonzero((np.diff(keys) != 0) | (np.diff(starts) != 0)) + 1
            bounds = [0, *edge.tolist(), len(keys)]
            held = [x[:0] for x in records]
            for s, e in zip(bounds, bounds[1:]):
                own, name = [x[s:e] for x in records], (int(starts[s]), int(keys[s]))
                if full == name or (heavy is not None and e - s > heavy):
                    full = name
                    yield _put_off(own)
                elif e == len(keys):
                    held = own  # the next batch may go on with this key
                elif e - s > 1:
                    _link(forest, name[0] % SEGMENTS, own[2], own[3])
            if len(forest.parent) >= UNITED:
                yield _edges(forest)
                forest = Forest()
        if len(held[0]) > 1:
            _link(forest, int(held[0][0]) % SEGMENTS, held[2], held[3])
        yield _edges(forest)

    return run


def near_duplicate_links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``a, b``: links that connect just the fingerprints (``fp``, distinct) that links connect."""
    keyed, out, rows = prints.select("fp").mapInArrow(_chain_keys, RECORDS), None, prints.count()
    for level in range(LEVELS + 1):
        last = level == LEVELS
        dealt = keyed.repartition(F.col("start"), F.col("key")).sortWithinPartitions("start", "key")
        found = gathered(dealt.mapInArrow(_links(None if last else heavy), LINKED), rows)
        links = found.filter("a is not null").select("a", "b")
        out = links if out is None else out.union(links)
        rest = found.filter("key is not null").select("start", "key", "fp", "exact")
        if last or rest.isEmpty():
            return out
        keyed = rest.mapInArrow(_part_keys(level), RECORDS)
    return out


def _components(prints: DataFrame) -> DataFrame:
    """``fp, root``: of fingerprints that link to another, the smallest of their component."""
    return cut(connected_components(near_duplicate_links(prints)).select(F.col("node").alias("fp"), "root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id, fp, component_id``: one row per row of ``docs``."""
    marked = cut(fingerprints(docs, id_col, text_col, words).select("id", "fp"))
    rows = marked.count()
    prints = gathered(marked.groupBy("fp").agg(F.min("id").alias("first_id")), rows)
    linked = _components(prints)
    first = gathered(linked.join(prints, "fp").groupBy("root").agg(F.min("first_id").alias("smallest")), rows)
    named = linked.join(first, "root").select("fp", "smallest")
    known = gathered(prints.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first_id").alias("component_id")), rows)
    return marked.join(known, "fp", "left").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    The winner is named by id and digest, which a second reading of ``docs`` finds again
    without the fingerprint; only rows that repeat both are merged further, by an aggregate that combines on the map side."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("digest"))
    marked = cut(fingerprints(slim, "id", "text", words, "digest"))
    # Null ids come after all others: min over a struct puts nulls first, so a flag leads.
    order = F.struct(F.col("id").isNull().alias("null"), "id", "fp", "digest")
    rows = cut(marked.groupBy("fp").agg(F.min(order).alias("best")))
    linked = _components(rows)
    rooted = rows.join(linked, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    stays = rooted.select(F.col("best.id").alias("id"), F.col("best.digest").alias("digest"))
    times = marked.groupBy("id", "digest").agg(F.count("*").alias("n"))
    same = stays["id"].eqNullSafe(times["id"]) & (stays["digest"] == times["digest"])
    kept = cut(stays.join(times, same).select(stays["id"].alias("_id"), stays["digest"].alias("_digest"), "n"))

    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("r"))
    packed = packed.withColumn("_key", F.col("r").getField(id_col).cast("long"))
    packed = packed.withColumn("_sum", F.md5(F.coalesce(F.col("r").getField(text_col).cast("string"), F.lit(""))))

    def those(condition: str) -> DataFrame:
        own = kept.filter(condition)
        return packed.join(own, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_digest")))

    repeated = those("n > 1").groupBy("_id", "_digest").agg(F.first("r").alias("r"))
    return those("n = 1").select("r.*").unionByName(repeated.select("r.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
