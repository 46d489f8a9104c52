"""The pipeline's stages against brute force on the smallest table."""

import itertools

import corpus_pipeline
from ledgerline.llm import decontam, ngram_join, packing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if not scores[r.doc_id]}
    last = {}
    for i in sorted(left):
        last[left[i]] = i
    left = {i: t for t, i in last.items()}
    sh = ngram_join.Shingler(5)
    sets = {i: set(sh(t).tolist()) for i, t in left.items()}
    group = {i: i for i in left}
    for a, b in itertools.combinations(sorted(left), 2):
        if sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = group[a], group[b]
            group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    left = {i: left[i] for i in left if group[i] == i}
    leaked = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = set(left) - leaked
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(left[i].split()) for i in want}
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert packing.pack(docs.limit(0)).count() == 0


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, very long and blank texts, columns named like those that the operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, _sha string, _file string"
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "  "), (4, "a"), (5, long), (6, long), (6, long), (None, "no id at all here, I say"), (None, None), (9, "日本語 ✓"), (10, "x" * 200_000)]
    rows = [(i, t, "en", "s", 0, 1.0, "y", "z", "f") for i, t in texts]
    for n, part in (("odd", rows), ("empty", [])):
        d = tmp_path / n
        spark.createDataFrame(part, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1)] if part else [], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "tiny"), (None, "x y z")] if part else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(d))
            assert out.columns == docs.columns
        kept = sorted((r.doc_id or 0) for r in out.collect())
        got = sorted((r.doc_id or 0) for r in corpus_pipeline.run(spark, str(d)).collect())
        assert got == kept == ([0, 2, 3, 4, 6, 9, 10] if part else [])
