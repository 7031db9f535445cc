import hashlib
import random
import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import bpe, exact_dedup, graph, pack, shard, simhash
from sluice.llm.common import shared_dir
from sluice.llm.pack import fewest, pack_documents, packed_sequences, sum_of_squares

SCHEMA = "doc_id long, text string, digest string, row long, id long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a"), (None, "c"), (None, "c"), (8, "d" * 100_000), (9, "b"), (9, "b")]


@pytest.mark.parametrize("heavy", [1, 1024])
def test_exact_duplicates_against_brute_force(spark, heavy):
    got = exact_dedup.exact_duplicates(docs(spark, ROWS), heavy=heavy, tracked=max(64, heavy)).collect()
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = sorted((t, len(g), max((i for i in g if i is not None), default=None)) for t, g in groups.items())
    texts = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    seen = {}
    for r in got:
        entry = seen.setdefault(texts[r.digest], [r.group_size, r.keep_id, 0, 0])
        assert entry[:2] == [r.group_size, r.keep_id]
        entry[2] += 1
        entry[3] += r.kept
    assert sorted((t, n, k) for t, (n, k, _, _) in seen.items()) == want
    assert all(rows == n and kept == 1 for n, _, rows, kept in seen.values())


@pytest.mark.parametrize("heavy", [1, 1024])
def test_dropping_keeps_rows_whole(spark, heavy):
    kept = exact_dedup.drop_exact_duplicates(docs(spark, ROWS), heavy=heavy, tracked=max(64, heavy))
    assert kept.columns == ["doc_id", "text", "digest", "row", "id"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert [(i, t) for i, t in got if i not in (5, None)] == [(6, "a"), (8, "d" * 100_000), (9, "b")] and len(got) == 5


def test_a_third_of_all_rows_is_one_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_duplicates(df, heavy=4, tracked=64)
    assert got.filter("kept").count() == 2001 and got.filter("group_size = 1000").count() == 1000


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0
    assert shard.scatter_shuffle(none, 8).count() == 0 and pack_documents(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 50])
def test_shards_are_a_balanced_gapless_permutation(spark, tmp_path, n):
    rows = [(i if i % 5 else None, "t" * (i % 4) if i % 3 else None) for i in range(n)]
    out = shard.write_shards(docs(spark, rows), f"{tmp_path}/s", 8, bucket_bytes=20).collect()
    assert sorted(((r.record.doc_id, r.record.text) for r in out), key=repr) == sorted(rows, key=repr)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_any_columns_and_repeated_rows_scatter(spark, tmp_path):
    rows = [(1, "same " * 20, {"a": [i]}, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, record map<string, array<long>>, bucket string")
    out = shard.write_shards(df, f"{tmp_path}/m", 8, bucket_bytes=200).collect()
    assert sorted(r.record.record["a"][0] for r in out) == list(range(300))
    assert sorted((r.shard, r.slot) for r in out) == sorted((k, n) for k in range(8) for n in range(38 if k < 4 else 37))
    # Rows of a table that repeat id and text are told apart by their place in it.
    df.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    placed = shard.scattered(read, 50, shard.row_place(read)).groupBy("bucket").count().collect()
    assert len(placed) > 40 and max(r["count"] for r in placed) < 30
    again = [shard.scatter_shuffle(read, 8, bucket_bytes=200).select("shard", "slot", "record.record").collect() for _ in range(2)]
    key = lambda r: (r.shard, r.slot)
    assert sorted(again[0], key=key) == sorted(again[1], key=key) and len(again[0]) == 300


def test_shuffle_mixes_and_repeats(spark):
    df = docs(spark, [(i, f"text {i}") for i in range(400)])
    place = lambda: [r.record.doc_id for r in shard.scatter_shuffle(df, 1, bucket_bytes=2000).orderBy("shard", "slot").collect()]
    one = place()
    assert one == place() and one != sorted(one)
    assert sum(abs(a - b) == 1 for a, b in zip(one, one[1:])) < 20


def test_shards_cover_sf(spark):
    from sluice.llm.shard import op2_shard

    out = op2_shard(spark, "/root/testdata/sf0.001")
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in src}
    assert {r.doc_id: (r.size, r.text_crc32) for r in out.collect()} == want


def best_fit(sizes, capacity):
    gaps, bins = [], 0
    for size in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
        else:
            bins += 1
        gaps.append((min(fits) if fits else capacity) - size)
    return bins


def brute_sum_of_squares(sizes, capacity, budget):
    """The rule by trying every open bin and summing the squares anew."""
    gaps, bins = [], []
    for size in sizes:
        def cost(changed):
            own = [g for g in changed if 0 < g < capacity]
            return sum(own.count(g) ** 2 for g in set(own))

        choices = [(cost([*gaps[:k], g - size, *gaps[k + 1 :]]), g, k) for k, g in enumerate(gaps) if g >= size]
        if len(gaps) < budget or not choices:
            choices.append((cost([*gaps, capacity - size]), capacity + 1, len(gaps)))
        _, _, k = min(choices, key=lambda c: c[:2])
        if k == len(gaps):
            gaps.append(capacity)
        gaps[k] -= size
        bins.append(k)
    return sorted(gaps), bins


@pytest.mark.parametrize("budget", [0, 9, None])
def test_sum_of_squares_against_brute_force(budget):
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randrange(1, 21) for _ in range(60)]
        limit = -(-sum(sizes) // 20) if budget is None else budget
        bins, _ = sum_of_squares(np.array(sizes), 20, budget)
        level = np.bincount(bins, sizes)
        assert sorted((20 - level).astype(int).tolist()) == brute_sum_of_squares(sizes, 20, limit)[0]


def test_packing_is_within_capacity_and_no_worse_than_best_fit():
    rng = random.Random(5)
    pools = [[rng.randrange(1, 100) for _ in range(500)], [rng.randrange(30, 40) for _ in range(500)], [rng.choice([1, 2, 50, 99, 100]) for _ in range(500)], []]
    for sizes in pools:
        sizes.sort(reverse=True)
        bins, offsets = fewest(np.array(sizes, dtype=np.int64), 100)
        level = {}
        for size, b, o in zip(sizes, bins.tolist(), offsets.tolist()):
            assert level.get(b, 0) == o
            level[b] = o + size
        assert max(level.values(), default=0) <= 100 and len(level) <= best_fit(sizes, 100) + 1


def test_both_tokenizers_agree_at_the_border():
    from tokenizers import Tokenizer

    rng = random.Random(13)
    reference = Tokenizer.from_file(bpe.vocabulary())
    base = "".join(rng.choice("aeiou tnrs\nthein-=#.12é́日本😀") for _ in range(5000))
    ranks = bpe.vocabulary("byte_bpe_50k.tiktoken")
    for n in (pack.LONG_TEXT - 1, pack.LONG_TEXT, pack.LONG_TEXT + 1):
        text = (base * (n // len(base) + 1))[: n - 14] + " <|endoftext|>"
        want = reference.encode(text, add_special_tokens=False).ids
        assert pack.token_ids(text, ranks, bpe.vocabulary()).tolist() == want


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(1, "hello world " * 40), (2, None), (3, ""), (4, "x y z"), (4, "x y z"), (None, "a<|endoftext|>b"), (7, "lorem ipsum " * 300)]
    reference = Tokenizer.from_file(bpe.vocabulary())
    got = packed_sequences(docs(spark, rows), capacity=64).collect()
    ids = {}
    for r in got:
        assert len(r.ids) <= 64
        place = 0
        for s in sorted(r.segments):
            assert s.offset == place
            place += s.length
            ids.setdefault((s.id, s.piece), []).append(r.ids[s.offset : s.offset + s.length])
    whole = {}
    for (i, piece), parts in sorted(ids.items(), key=lambda x: (repr(x[0][0]), x[0][1])):
        whole.setdefault(i, []).append(parts)
    for i, t in rows:
        want = [*reference.encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for parts in whole[i] for x in parts[0]] == want
    assert len(ids[4, 0]) == 2
    assert all(s.length == 64 for r in got for s in r.segments if s.piece > 0)


def brute_components(rows):
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    f = simhash.Forest()
    for a in prints:
        f.find(a)
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                f.unite(a, b)
    least = {}
    for (i, _), p in zip(rows, prints):
        r = f.find(p)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, p, least[f.find(p)]) for (i, _), p in zip(rows, prints)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(9)) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300, ""), (301, None), (302, " \t\n"), (303, "One"), (304, "oNE"), (None, base[0]), (305, "A b"), (306, "word " * 50_000), (307, "a b c")]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    want = sorted(((i, p - (1 << 64) if p >> 63 else p, c) for i, p, c in brute_components(rows)), key=repr)
    assert sorted(((r.id, r.fp, r.component_id) for r in got), key=repr) == want
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    assert kept == sorted({c for _, _, c in want})


def test_dropping_near_duplicates_loses_no_text(spark):
    base = [" ".join(f"w{k * 100 + j}" for j in range(60)) for k in range(6)]
    near = base[1].replace("w159", "w159x")
    assert 0 < (simhash.fingerprint(base[1].encode()) ^ simhash.fingerprint(near.encode())).bit_count() <= 3
    # Text 0 shares its id with text 1, whose near copy has a smaller id; null and repeated ids, and rows repeated whole.
    rows = [(5, base[0]), (5, base[1]), (2, near), (None, base[2]), (None, base[3]), (None, base[3]), (7, base[4]), (7, base[4]), (None, base[4]), (9, None), (9, "")]
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "row", "id"]
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted([(5, base[0]), (2, near), (None, base[2]), (None, base[3]), (7, base[4]), (9, "")], key=repr)


def test_full_keys_are_dealt_out_and_lose_no_link(spark):
    rng = random.Random(7)
    # 600 fingerprints under one key: two segments are equal; 40 of them also share 8 more bits.
    open_bits = [k for k in range(64) if k >= 32]
    prints = {0xBEEF1234 | (rng.getrandbits(32) << 32) for _ in range(560)} | {0xBEEF1234 | (0xAA << 32) | (rng.getrandbits(24) << 40) for _ in range(40)}
    for p in list(prints)[:200]:
        q = p
        for bit in rng.sample(open_bits, rng.randrange(1, 4)):
            q ^= 1 << bit
        prints.add(q)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    want = simhash.Forest()
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                want.unite(a, b)
    for heavy in (8, 100, 4096):
        got = simhash.Forest()
        for r in simhash.near_duplicate_links(df, heavy=heavy).collect():
            got.unite(r.a % (1 << 64), r.b % (1 << 64))
        assert {p: want.find(p) for p in want.parent} == {p: got.find(p) for p in list(got.parent)}


@pytest.mark.parametrize("alone", [0, graph.ALONE])
def test_components_of_few_and_of_many_edges(spark, alone):
    rng = random.Random(3)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000)]
    edges += [(-(1 << 63), (1 << 63) - 1), *[(5000, 5001 + k) for k in range(200)]]
    want = simhash.Forest()
    for a, b in edges:
        if a != b:
            want.unite(a, b)
    got = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), alone).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, want.find(x)) for x in list(want.parent))


def checkpointed(spark, pattern):
    return set(Path(urlparse(spark.sparkContext.getCheckpointDir()).path).glob(pattern))


def test_few_links_make_few_tables(spark):
    # A chain, each fingerprint three bits from the next: rounds over it would checkpoint three tables each.
    prints = [0x0123456789ABCDEF]
    for k in range(0, 63, 3):
        prints.append(prints[-1] ^ (7 << k))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    shared_dir(spark)
    before = checkpointed(spark, "rdd-*")
    found = simhash._components(df).collect()
    assert len(checkpointed(spark, "rdd-*") - before) <= 2
    assert {r.fp % (1 << 64) for r in found} == set(prints) and len({r.root for r in found}) == 1


def test_files_go_by_rows_and_not_by_shuffle_partitions(spark):
    rows = [(k, f"text {k % 7} of near copies") for k in range(40)]
    df = docs(spark, rows).coalesce(1)
    shared_dir(spark)
    own = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        before = checkpointed(spark, "rdd-*/part-*")
        got = simhash.near_duplicates(df).collect()
        assert len(checkpointed(spark, "rdd-*/part-*") - before) < 23
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert sorted((r.id, r.component_id) for r in got) == [(i, c) for i, _, c in brute_components(rows)]


def test_every_pair_within_three_bits_meets(spark):
    rng = random.Random(2)
    prints, pairs = [], []
    for _ in range(150):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        prints += [a, b]
        pairs.append((a, b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    links = {frozenset((r.a, r.b)) for r in simhash.near_duplicate_links(df).collect()}
    assert links == {frozenset((signed(a), signed(b))) for a, b in pairs}


def test_bits_set_in_half_the_hashes_are_zero():
    import xxhash

    a, b = (xxhash.xxh64_intdigest(x, 42) for x in (b"p q r", b"q r s"))
    assert simhash.fingerprint(b"P q r s") == a & b
