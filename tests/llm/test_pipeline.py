from test_dedup_shard import best_fit, brute_components

from sluice.llm import bpe, pipeline, toxicity
from sluice.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.columns
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == before
        seen.append({r.doc_id: r.text for r in docs.collect()})
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert seen[1] == {i: t for i, t in seen[0].items() if model.score(t)[0] < 0.5}
    last = {t or "": i for i, t in sorted(seen[1].items())}
    assert set(seen[2]) == set(last.values())
    assert set(seen[3]) == {c for _, _, c in brute_components(sorted(seen[2].items()))}
    packed = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    own = bpe.load(bpe.vocabulary())
    sums, bins = {}, {}
    for r in packed:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sums == {i: len(own.encode(t or "")) + 1 for i, t in seen[3].items()}
    for parts in bins.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 2048
    assert len(bins) <= best_fit([r.length for r in packed], 2048) + 1


def test_run_gives_the_last_stage(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_an_empty_table_passes_all_stages(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_clashing_columns_pass_the_filters(spark):
    rows = [(i, f"some words of text number {i % 7} and more of them", 1, 2, 3, 4) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, fp long, component_id long, score long")
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.columns
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == before
    assert docs.count() == 7


def test_null_and_repeated_ids_lose_no_text(spark):
    texts = [" ".join(f"w{k * 50 + j}" for j in range(40)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[3]), (7, None), (8, ""), (2, texts[3].replace("w150", "w150x")), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
    kept = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    # Exact copies leave the largest id, near copies the smallest.
    assert kept == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (2, rows[8][1]), (8, "")], key=repr)
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("doc_id").count().count() == 4 and packed.filter("piece = 0").count() == 5
