import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluice.llm import ann, bpe, chat, html_text, toxicity, warc

DOCS = "doc_id long, text string, score double, record string, evidence string"


def test_bpe_equals_the_library_and_round_trips(spark):
    rng = random.Random(4)
    texts = [None, "", "  a\n\n b\t\x1c\x85 x", "<|endoftext|>a<|endoftext|><|endoft", "we'll 'LL it's", "a" * 5000, "   " * 100 + "x", "日本語😀🏽‍♂️", "=" * 999]
    texts += ["".join(rng.choice("aeiou tnrs\nthein-=#.12é́" + chr(rng.randrange(1, 0xD7FF))) for _ in range(rng.randrange(90))) for _ in range(300)]
    reference = Tokenizer.from_file(bpe.vocabulary())
    df = spark.createDataFrame([(i, t, 0.0, "", "") for i, t in enumerate(texts)], DOCS)
    got = {r.id: r for r in bpe.encode_decode(df).collect()}
    for i, t in enumerate(texts):
        want = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want and got[i].decoded == reference.decode(want, skip_special_tokens=False)
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_decoding_any_ids():
    reference, own = Tokenizer.from_file(bpe.vocabulary()), bpe.load(bpe.vocabulary())
    rng = random.Random(8)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, dtype=np.uint32)) == reference.decode(ids, skip_special_tokens=False)


PAGES = "page_id long, url string, html string, digest string, payload string"


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "aa"), (2, "v\r\nX: y", "bb"), (3, None, "aa"), (0, "w", None), (5, "w", ""), (None, "n", "zz"), (None, "n", "zz"), (7, "big", "é" * 300_000), (8, "c", "aa\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES)
    at = f"file://{tmp_path}/warc"
    manifest = warc.write_warc(warc.with_revisits(df), at, archive_bytes=2000)
    got = warc.read_warc(manifest, at).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"aa": 1, "": 0}
    want = []
    for i, _, t in rows:
        to = first.get(t or "")
        to = None if to in (None, i) else to
        want.append((i, len((t or "").encode()), digest(t), "revisit" if to is not None else "response", to))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert all((r.payload or b"").decode() == dict((i, t or "") for i, _, t in rows)[r.page_id] for r in got if r.record_type == "response")
    none = warc.write_warc(warc.with_revisits(df.limit(0)), at)
    assert warc.read_warc(none, at).count() == 0


def test_record_ids_are_unique_and_revisits_name_their_response(spark, tmp_path):
    rows = [(1, "u", "aa", "", ""), (1, "u", "aa", "", ""), (None, "n", "aa", "", ""), (None, None, "aa", "", ""), (2, "v", "aa", "", "")]
    at = tmp_path / "w"
    warc.write_warc(warc.with_revisits(spark.createDataFrame(rows, PAGES)), f"file://{at}").collect()
    heads = [warc.parse_record(raw)[0] for f in at.glob("*.gz") for raw in warc.members(f.open("rb"))]
    assert len({h["warc-record-id"] for h in heads}) == 5
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 3 and all(h["warc-refers-to-target-uri"] == "u" and h["x-refers-to-page-id"] == "1" for h in revisits)


def test_many_small_members_are_read_in_linear_time():
    import gzip
    import io
    import time

    began = time.perf_counter()
    assert sum(len(x) for x in warc.members(io.BytesIO(gzip.compress(b"abc") * 40_000))) == 120_000
    assert time.perf_counter() - began < 3


def test_long_texts_are_encoded_a_few_pieces_at_a_time(monkeypatch):
    own, text = bpe.load(bpe.vocabulary()), "some words, 12 of them\n <|endoftext|> é " * 300
    want = own.encode(text).tolist()
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "FLUSH", 7)
    assert own.encode(text).tolist() == want and own.encode(text.replace("<|endoftext|>", "")).tolist()
    assert Tokenizer.from_file(bpe.vocabulary()).encode(text, add_special_tokens=False).ids == want


def test_warc_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "aa", "", ""), (2, "v", "aa", "", ""), (3, "w", "aaaa", "", ""), (4, "x", "aaaa", "", "")], PAGES)
    assert sorted((r.page_id, r.refers_to) for r in warc.with_revisits(df, least=3).collect()) == [(1, None), (2, None), (3, None), (4, 3)]


def test_damaged_records_raise():
    raw = warc.build_record(1, "u", b"payload", None)
    assert warc.decode_record(raw)[6] == b"payload"
    with pytest.raises(ValueError):
        warc.decode_record(raw.replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.decode_record(raw[:-1])


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p>one", "one"),
        ("<nav><p>Menu, here.</p></nav>", ""),
        ("<body><nav>m</nav><article><h1>T</h1><p>A &amp; b<br>c.<p>Of.</article><footer>x</footer>", "T A & b c. Of."),
        ("<article><p>x<b>y</b>z</p><aside>no</aside><div class='reader-comments'>bad</div><script>var a='</p>'</script></article>", "xyz"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>cut</p><div cla", "cut"),
        ('<div id="cookie-notice">Ok.</div><main><ul><li>a</li><li>b</li></ul></main>', "a b"),
        ("<header>H</header><article><p>t</p></article>", "t"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "A long sentence, with commas, and a stop. " * 20


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<article><h1>T</h1><section><p>{LONG}</p></section><section><p>Short.</p></section></article>", f"T {LONG} Short."),
        (f"<article><h1>T</h1><div class='lead'>Lead</div><div class='body'>{LONG}</div></article>", f"T Lead {LONG}"),
        (f"<main><h1>T</h1><article><div><p>{LONG}</p></div><p>End.</p></article></main>", f"T {LONG} End."),
        (f"<main><article><p>One.</p></article><article><p>{LONG}</p></article><p>{LONG}</p></main>", f"One. {LONG} {LONG}"),
        (f"<body><div class='x'><div class='a'><p>{LONG}</p></div><p>Between.</p><div class='b'><p>{LONG[:126]}</p></div></div><div>no</div></body>", f"{LONG} Between. {LONG[:126]}"),
        (f"<body><div><p><a href='/'>no</a></p><div class='x'><h1>T</h1><div class='lead'>Lead</div><div class='y'>{LONG}</div></div></div></body>", f"T Lead {LONG}"),
        (f"<body><h2>no</h2><p>{LONG}</p><article><h1>T</h1><div><p>{LONG * 2}</p></div><p>End.</p></article></body>", f"T {LONG * 2} End."),
    ],
)
def test_main_text_is_the_whole_article(page, text):
    assert html_text.main_text(page) == " ".join(text.split())


LINKS = "<ul><li><a href='/a'>One more, please.</a></li><li><a href='/b'>Two</a></li></ul>"


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='content with-sidebar'><h1>T</h1><p>{LONG}</p></div>", f"T {LONG}"),
        ("<main><div class='post no-comments'><p>Short.</p></div></main>", "Short."),
        (f"<article><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>Others did it.</p></section></article>", f"{LONG} Related work Others did it."),
        (f"<article><div class='post-header'><h1>T</h1></div><p>{LONG}</p><section id='legal'><p>Law, too.</p></section></article>", f"T {LONG} Law, too."),
        (f"<div class='layout-sidebar'><div class='nav'>{LINKS}</div><main><p>{LONG}</p></main></div>", LONG),
        (f"<article><p>{LONG}</p><div class='related-posts'><h3>no</h3>{LINKS}</div><div class='share'>Share on X</div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='post-comments'><p>Bad, bad.</p></div><div id='side-bar'>{LONG}</div><div class='post related'>{LINKS}</div></article>", LONG),
        (f"<div class='sidebar'><p>{LONG}</p></div><div id='comments-list' class='wide'>{LONG}</div>", ""),
    ],
)
def test_names_exclude_only_what_they_name(page, text):
    assert html_text.main_text(page) == " ".join(text.split())


def test_main_text_without_an_article_element():
    words = "Long sentences, with commas and stops. " * 5
    page = f'<body><div><a href="/">home</a> <a href="/b">b</a></div><div class="x"><p>{words}</p><p>Short.</p></div><div class="sidebar"><p>{words}</p></div></body>'
    assert html_text.main_text(page) == " ".join((words + " Short.").split())


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "t", ""), (1, "u", "<p>a", "t", ""), (None, None, None, "t", "")], PAGES)
    assert sorted(((r.page_id, r.text) for r in html_text.extract(df).collect()), key=repr) == [(1, "a"), (1, "a"), (None, "")]


def test_block_max_index_is_exact():
    rng = random.Random(6)
    vector = lambda: {min(rng.randrange(12), rng.randrange(60)): rng.choice([rng.random(), 0.5]) for _ in range(rng.randrange(0, 6))} | {rng.randrange(12, 60): 0.5}
    rows = [vector() for _ in range(400)]
    flat = [(i, t, w) for i, v in enumerate(rows) for t, w in v.items()]
    index = toxicity.BlockMaxIndex(*(np.array(x) for x in zip(*flat)), 400, 60, block=16)
    queries = [dict(sorted(vector().items())) for _ in range(150)]
    answers = index.nearest([(np.array(list(q), np.int64), np.array(list(q.values()))) for q in queries], 10)
    assert index.columns.shape[1] > 0 and len(index.at) > 0
    for q, got in zip(queries, answers):
        dots = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), n) for n, v in enumerate(rows)))
        want = [(-d, n) for d, n in dots if d < 0][:10]
        assert [n for _, n in got] == [n for _, n in want] and np.allclose([p for p, _ in got], [p for p, _ in want])


def brute_scores(docs, labels):
    """Scores of texts by the definition: dictionaries, all pairs, and isotonic values as the largest of least means."""
    words = lambda t: Counter(re.findall(r"\w+", (t or "").lower()))
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    marks = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and not out(i):
            marks[i] = max(y, marks.get(i, 0))
    texts = {}
    for i, t in docs:
        if i in marks:
            texts[i] = max(t or "", texts.get(i, ""))
    rows_of = {k: sum(y == k for y in marks.values()) / max(1, sum(marks[i] == k for i in texts)) for k in (0, 1)}
    df = Counter(w for _, t in docs for w in words(t))
    idf = lambda w: math.log((1 + len(docs)) / (1 + df[w])) + 1

    def voter(own):
        n, ones = len(own), sum(marks[i] for i in own)
        with_term = {k: Counter(w for i in own if marks[i] == k for w in words(texts[i])) for k in (0, 1)}

        def factor(w):
            a, b = with_term[1][w], with_term[0][w]
            under = (a + b) * (n - a - b) * ones * (n - ones)
            chi = n * (a * (n - ones - b) - b * (ones - a)) ** 2 / under if under else 0
            return idf(w) * chi / (chi + 20)

        def unit(t):
            v = {w: (1 + math.log(c)) * factor(w) for w, c in words(t).items() if w in with_term[0] or w in with_term[1]}
            norm = math.sqrt(sum(x * x for x in v.values()))
            return {w: x / norm for w, x in v.items() if x}

        vectors = [(i, unit(texts[i])) for i in sorted(own)]
        prior = sum(rows_of[marks[i]] * marks[i] for i in own) / sum(rows_of[marks[i]] for i in own)

        def vote(t):
            q = unit(t)
            near = sorted((-round(sum(x * v.get(w, 0) for w, x in q.items()), 12), k) for k, (_, v) in enumerate(vectors))
            near = [(-d, vectors[k][0]) for d, k in near if d < 0][:15]
            w = [rows_of[marks[i]] / (0.01 + max(0, 1 - p)) for p, i in near]
            return (1e-3 * prior + sum(x * marks[i] for x, (_, i) in zip(w, near))) / (1e-3 + sum(w))

        return vote

    part = lambda i: zlib.crc32(str(i).encode()) // 5 % 4
    votes = sorted((voter([j for j in texts if part(j) != part(i)])(texts[i]), i) for i in texts)
    xs = sorted({round(v, 9) for v, _ in votes})
    at = {x: (sum(rows_of[marks[i]] * marks[i] for v, i in votes if round(v, 9) == x), sum(rows_of[marks[i]] for v, i in votes if round(v, 9) == x)) for x in xs}
    mean = lambda i, j: sum(at[x][0] for x in xs[i : j + 1]) / sum(at[x][1] for x in xs[i : j + 1])
    values = [max(min(mean(i, j) for j in range(k, len(xs))) for i in range(k + 1)) for k in range(len(xs))]
    whole = voter(list(texts))
    return [float(np.interp(whole(t), xs, values)) for _, t in docs]


def test_toxicity_against_brute_force(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join([*rng.choices(words, k=rng.randrange(12)), *(["Vile"] * (i % 3 == 0 and rng.random() < 0.8)), *(["sour"] * (rng.random() < 0.1))])) for i in range(130)]
    docs += [(130, None), (131, ""), (7, "vile again"), (None, "vile")]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 120)] + [(5, 1), (None, 1), (6, None), (8, 4)]
    kept = spark.createDataFrame([(i, t, 0.0, "", "") for i, t in docs], DOCS)
    model = toxicity.fit(kept, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [model.score(t)[0] for _, t in docs]
    assert np.allclose(got, brute_scores(docs, labels), atol=1e-6) and len(set(got)) > 5


def test_toxicity_finds_held_out_rows(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            text[5:7] = rng.sample(["vileone", "viletwo", "vilethree"], 2)
        rows.append((i, " ".join(text), 0.1, "r", "e"))
        labels.append((i, int(bad)))
    rows += [(700, None, 0.0, "", ""), (701, "", 0.0, "", ""), (701, "", 0.0, "", ""), (None, "vileone", 0.0, "", ""), (702, "w1 " * 50_000, 0.0, "", "")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = dict(labels)
    assert all((r.score >= 0.5) == bool(truth[r.record.doc_id]) for r in got if r.record.doc_id in truth)
    assert all(r.score < 0.5 for r in got if r.record.doc_id in (700, 701, 702))
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.filter("doc_id % 6 = 0 and doc_id < 600").count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert {r.score for r in toxicity.scored(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0.0}


def test_toxicity_query_writes_few_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"word{i % 7} " + "vile" * (i % 5 == 0), 0.0, "", "") for i in range(99)] + [(None, "vile", 0.0, "", ""), (7, None, 0.0, "", "")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    docs.repartition(24).write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "PER_FILE", 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert toxicity.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() > 12
        toxicity.op1_toxicity(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
    want = toxicity.scored(docs, toxicity.fit(docs, marks)).collect()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(repr((r.doc_id, r.score, r.evidence)) for r in got.collect()) == sorted(repr((r.record.doc_id, r.score, r.evidence)) for r in want)
    assert got.filter("predicted != int(score >= 0.5) or held_out != (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0


def test_every_word_of_the_examples_is_a_term(spark):
    rows = [(i, f"once{i} word", 0.0, "", "") for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, int(i < 9)) for i in range(60)], "doc_id long, toxic int"))
    assert set(model.terms.number) == {"word"} | {f"once{i}" for i in model.ids.tolist()}


def test_ann_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0], 1), (None, [1.0] * 16, 1), (20, x[20].tolist(), 1), (2080, [None] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, best int")
    got = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    y, hits = x.astype(float), 0
    for q, found in got.items():
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        score = y @ y[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(900), -np.round(score, 9)))[:20].tolist()
        hits += len(set(want) & {i for _, i, _ in found})
        assert np.allclose([s for _, _, s in found], [score[i] for _, i, _ in found])
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert hits >= 0.9 * 20 * len(got)
    copies = [i for _, i, _ in got[120] if 100 <= i < 300]
    assert copies == [i for i in range(100, 300) if i != 120][: len(copies)]


def test_ann_with_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest_neighbours(spark.createDataFrame([], kind), lambda i: i % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], kind)
    assert [(r["rank"], r.vec_id) for r in ann.nearest_neighbours(few, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_ann_default_recall_on_calibrating_queries(spark):
    # All 200 queries calibrate, so the recall they were promised is the recall they get.
    x = np.random.default_rng(11).normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, lambda i: i % 20 == 0).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {q: set(np.argsort(-score[q])[:20].tolist()) for q in range(0, 4000, 20)}
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits >= 0.95 * 20 * 200, hits / 4000


def test_ann_scores_few_rows_of_clustered_data(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.35 * rng.normal(size=(6000, 32))
    df = spark.createDataFrame([(i, v.tolist(), "g", 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, group string, leaf int")
    # 64 of 300 queries calibrate; recall is that of the others, too.
    monkeypatch.setattr(ann, "CALIBRATION", 64)
    visited = []
    monkeypatch.setattr(ann, "_calibrated", lambda *a, own=ann._calibrated: visited.append((own(*a), a[2].leaves)) or visited[-1][0])
    got = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = sum(len(got[q] & set(np.argsort(-score[q])[:20].tolist())) for q in range(0, 6000, 20))
    visits, leaves = visited[0]
    assert hits >= 0.9 * 20 * 300 and visits < 0.2 * leaves


def test_leaves_stand_in_groups_of_a_chunk():
    group_of, parts = ann.grouped_leaves({3: 5, 0: 4, 1: 4, 2: 30, 5: 1}, chunk=10)
    assert group_of == {0: 0, 1: 0, 2: 1, 3: 2, 5: 2} and parts == {0: 1, 1: 3, 2: 1}


def test_ann_chunks_of_any_size_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(9).normal(size=(400, 8)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = []
    for chunk, pending in ((8192, 1 << 20), (50, 100), (30, 7)):
        monkeypatch.setattr(ann, "PENDING", pending)
        monkeypatch.setattr(ann, "grouped_leaves", lambda sizes, chunk=chunk, own=ann.grouped_leaves: own(sizes, chunk))
        monkeypatch.setattr(ann, "QUERIES", chunk)
        out.append(sorted(tuple(r) for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0, target=1.0).collect()))
        monkeypatch.undo()
    assert out[0] == out[1] == out[2] and len(out[0]) == 400


def test_ann_rows_repeated_over_partitions_hold_one_place(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))
    x[1], x[2] = 3 * x[0], -0.0 * x[0]
    x[2][0] = 4 * np.abs(x).max() * np.sign(x[0][0])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # Every one of 30 partitions holds the rows 1 and 2; the zeros of row 2 have either sign.
    dealt = [[*rows[n::30], rows[1], (2, [abs(v) if n % 2 and not v else v for v in rows[2][1]])] for n in range(30)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(dealt, 30).flatMap(list), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest_neighbours(df, lambda i: i % 20 == 0, target=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(got) == list(range(0, 200, 20))
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        assert [i for _, i in sorted(found)] == np.argsort(-score)[:20].tolist()


def test_chat_rotation(spark):
    talk = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "x"), (1, 2, None, "x"), (1, 3, "unknown", "<|im_end|>\n<|im_start|>user"), (1, 4, "a\n<|im", "long " * 100_000), (None, None, "z", "lone"), *[(2, i, "ab"[i % 2], f"t{i}") for i in range(200)]]
    df = spark.createDataFrame([(*t, 0, "") for t in talk], "conv_id long, turn long, role string, text string, start long, rendered string")
    views = {}
    for r in chat.perspectives(df).collect():
        views.setdefault((r.conv_id, r.participant), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "<|none|>"), (1, "unknown"), (1, "a\\n<\\|im"), (None, "z"), (2, "a"), (2, "b")}
    for (conv, who), rows in views.items():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(len(rows)))
        whole = "".join(r.rendered for r in rows)
        name = lambda ro: "<|none|>" if ro is None else ro.replace("<|", "<\\|").replace("\n", "\\n")
        own = [(t, name(ro), (x or "").replace("<|", "<\\|")) for c, t, ro, x in talk if c == conv]
        assert whole.count("<|im_start|>") == whole.count("<|im_end|>") == len(rows)
        want = "".join(f"<|im_start|>{'assistant' if ro == who else 'user name=' + ro}\n{x}<|im_end|>\n" for _, ro, x in sorted(own, key=lambda o: (o[0] or 0, o[1], o[2])))
        assert whole == want
        for r in rows:
            assert whole[r.start : r.start + len(r.rendered)] == r.rendered and (r.mask_start is not None) == (r.speaker == who)
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_end].endswith("<|im_end|>") and whole[r.mask_start - 1] == "\n"
    assert chat.perspectives(df.limit(0)).count() == 0
