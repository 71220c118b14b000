"""The stages over one another, each against brute force on its own input."""

from collections import defaultdict

import sentencepiece

import corpus_pipeline
from quarry.llm import toxicity
from quarry.llm.queries import vocabulary
from tests.llm.test_llm_operators import brute_components, brute_contamination
from tests.llm.test_shingle_join import shingles, similar

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = map(rows, kept["toxicity"])
    assert set(after) <= set(before) and len(after) > 0.8 * len(before)

    before, after = map(rows, kept["exact_dedup"])
    best = defaultdict(lambda: -1)
    for i, t in before:
        best[t] = max(best[t], i)
    assert sorted(after) == sorted((i, t) for t, i in best.items())

    before, after = map(rows, kept["simhash"])
    roots = brute_components([shingles(t) for _, t in before], similar)
    least = {}
    for (i, t), r in zip(before, roots):
        least[r] = min(least.get(r, (i, t)), (i, t))
    assert sorted(after) == sorted(least.values())

    before, after = map(rows, kept["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    after = dict(after)
    for i, t in before:
        n, hit, *_ = brute_contamination(t, items)
        if not hit:
            assert after[i] == t
        elif hit < n:
            assert brute_contamination(after[i], [])[0] == n - hit
        else:
            assert i not in after

    before, after = kept["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in after.collect()} == {r.doc_id: library.encode(r.text) for r in before.collect()}


def written(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    ids = sorted({i for i, _ in rows if i is not None})
    spark.createDataFrame([(i, 1, int(k % 3 == 0)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("x", "foo bar baz qux ni ki the of one two"), ("y", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_over_odd_rows_scores_each_once(spark, tmp_path, odd_rows, monkeypatch):
    written(spark, tmp_path, odd_rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    want = sorted(map(repr, docs.collect()))
    scored, real = spark.sparkContext.accumulator(0), toxicity._scores

    def counting(*options):
        score = real(*options)

        def run(batches):
            def each():
                for b in batches:
                    scored.add(len(b))
                    yield b

            yield from score(each())

        return run

    monkeypatch.setattr(toxicity, "_scores", counting)
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want and want
    assert scored.value == len(odd_rows)


def test_run_without_rows(spark, tmp_path):
    written(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
