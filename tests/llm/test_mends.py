"""Hot texts beyond the broadcast bound, tables derived from files, labels of one class, safe softmax, layouts of files."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, lm, packing, toxicity

SF = "/root/testdata/sf0.001"


def expected(rows):
    of = defaultdict(list)
    for i, t in rows:
        of[t].append(i)
    return {(i, max(of[t]), len(of[t])) for i, t in rows}


def test_hot_texts_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    """Half of all rows are one text; digests of the others collide."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    rows = [(i, "hot text " * 5 if i % 2 else f"text {i % 900}") for i in range(24_000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for digest in (exact_dedup.sha256, lambda t: F.pmod(F.xxhash64(t), F.lit(101)).cast("string")):
        got = exact_dedup.groups(docs, digest).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.keep_id, r.group_size) for r in got} == expected(rows)
    assert exact_dedup.deduplicated(docs).count() == len({t for _, t in rows})


def test_groups_of_a_table_derived_from_files(spark, tmp_path):
    rows = [(1, "A b"), (2, "a B"), (3, "c"), (4, "C"), (5, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    low = spark.read.parquet(str(tmp_path / "docs")).withColumn("text", F.lower("text"))
    got = exact_dedup.groups(low).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == expected([(i, t.lower()) for i, t in rows]) and sum(r.kept for r in got) == 3


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_class_score_their_share_and_reject_nothing(spark, toxic):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(30)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = [r.score for r in toxicity.score(docs, model).collect()]
    assert got == pytest.approx([21 / 22 if toxic else 1 / 22] * 31) and toxicity.accepted(docs, model).count() == 31
    assert toxicity.fit(docs, labels.limit(0)).intercept < -10


def test_softmax_of_far_scores(spark):
    net = lm.Network.__new__(lm.Network)
    net.ones = np.ones(4, np.float32)
    rows = np.array([[-120, -121, -122, -120], [200, 100, 0, 199], [1, 2, 3, 4], [-1e9, -1e9, -500, -501], [-1e9, 70, -1e9, 0]], np.float32)
    want = rows.astype(np.float64)
    want = want - want.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    for y in range(4):
        got = net._softmax(rows, np.eye(4, dtype=np.float32), np.full(5, y))
        assert np.isfinite(got).all() and got == pytest.approx(want[:, y], rel=1e-5, abs=1e-5)


def test_scores_do_not_depend_on_the_layout_of_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cfg = lm.LmConfig(groups=8, members=8, tail_classes=12, dim=8, part_tokens=20_000)
    got = []
    for k, parts in enumerate((1, 7)):
        docs.repartition(parts, F.xxhash64("doc_id") if k else F.lit(1)).write.parquet(str(tmp_path / f"d{k}"))
        got.append({r.doc_id: (r.score, r.base_score) for r in lm.score_documents(spark.read.parquet(str(tmp_path / f"d{k}")), cfg).collect()})
    assert set(got[0]) == set(got[1]) and all(got[0][d] == pytest.approx(got[1][d], rel=1e-4) for d in got[0])


def test_packing_takes_every_length_however_many_there_are(spark):
    lengths = spark.range(1, 100_502).select(F.col("id").alias("n_tokens"))
    found = packing.histogram(lengths, packing.PackConfig().exact)
    assert found == [(n, 1) for n in range(1, 100_502)]  # more than were binned before


def test_lm_words_and_tail_classes_of_whole_arrays():
    """What is done for all words at once against the definitions, which go word by word."""
    parts, rng = ["", " ", "\t\n", "A", "aB", "the", "Éa", "日本", "\x0b\x1c ", "word-12", "\x85", " x "], np.random.default_rng(3)
    texts = pa.array(["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 9))) for _ in range(500)] + [None, "", "z" * 5000])
    cfg = lm.LmConfig(groups=2, members=3, tail_classes=128)
    own = {b"": 0, b"the": 1, b"a": 2}
    for lot in (texts, texts[7:300]):
        words, sizes = lm.parted(lot)
        want = [lm.words_of(t) for t in lot.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == sum(want, [])
        assert lm.tail_classes(words, 128).tolist() == [lm.tail_class(w, 128) for w in words.to_pylist()]
        assert lm.Encoder(own, cfg)(words).tolist() == [own.get(w, 6 + lm.tail_class(w, 128)) for w in words.to_pylist()]
        bounds = list(lm.runs(lot, 40))
        assert [k for a, b in bounds for k in range(a, b)] == list(range(len(lot)))
        assert all(b == a + 1 or sum(len((t or "").encode()) for t in lot[a:b].to_pylist()) <= 40 for a, b in bounds)


def test_lm_step_gathers_repeated_words():
    """A step over a minibatch of few words against the formula, token by token in doubles."""
    cfg = lm.LmConfig(groups=2, members=3, tail_classes=2, dim=4, noise=3, inner_noise=2)
    top, inner = np.array([0.5, 0.3, 0.1, 0.1]), np.array([0.5, 0.3, 0.2, 0.6, 0.3, 0.1])
    p, noise, rng = lm.start(top, inner, cfg), lm.Noise(top, inner, cfg), np.random.default_rng(1)
    ctx, y = rng.integers(0, 8, (2, 50)), rng.integers(0, 8, 50)
    was, sums = {k: v.astype(np.float64) for k, v in p.items()}, {k: np.full_like(v, 1e-4) for k, v in p.items()}
    lm.nce_step(p, sums, ctx, y, noise, np.random.default_rng(9), cfg, 0.2)
    draw, g = np.random.default_rng(9), {k: np.zeros_like(v) for k, v in was.items()}
    group = np.where(y < 6, y // 3, y - 4)
    z, met = noise.top(draw), np.unique(group[y < 6])
    zi = dict(zip(met, noise.inner(met, draw)))
    for t in range(50):
        h, gh = sum(was["r"][ctx[i, t]] @ was["c"][i] for i in range(2)), np.zeros(4)
        pairs = [("q", "b", group[t], 1, noise.log_top)] + [("q", "b", k, 0, noise.log_top) for k in z]
        if y[t] < 6:
            pairs += [("w", "v", y[t], 1, noise.log_inner)] + [("w", "v", k, 0, noise.log_inner) for k in zi[group[t]]]
        for m, b, k, data, log in pairs:
            up = (data - 1 / (1 + np.exp(-(was[m][k] @ h + was[b][k] - log[k])))) / 50
            gh, g[m][k], g[b][k] = gh + up * was[m][k], g[m][k] + up * h, g[b][k] + up
        for i in range(2):
            g["r"][ctx[i, t]] += was["c"][i] @ gh
            g["c"][i] += np.outer(was["r"][ctx[i, t]], gh)
    for k in p:
        assert p[k] == pytest.approx(was[k] + 0.2 * g[k] / np.sqrt(1e-4 + g[k] ** 2), rel=1e-3, abs=1e-4), k


def test_lm_sums_of_a_short_text_do_not_depend_on_long_ones_beside_it():
    """base of each text is summed alone: a million words before it leave no rounding in it."""
    model = lm.LanguageModel(lm.LmConfig(groups=2, members=2, tail_classes=2, dim=2), None, 10, 3, 2, {b"": 0, b"a": 1}, {b"a": 5, b"b": 3}, [(3, 1), (0, 0)], None)
    top, inner = np.array([0.7, 0.1, 0.1, 0.1]), np.full(4, 0.5)
    model.params = lm.start(top, inner, model.cfg)
    texts = pa.array(["a b " * 500_000, "a b c a c"])
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([5, None], pa.int64()), texts], ["uid", "doc_id", "text"])
    rows = pa.Table.from_batches(list(lm._score_task(model)(iter([batch])))).to_pylist()
    short = next(r for r in rows if r["uid"] == 1 and r["salt"] == 2)
    log = lambda c: np.log10((c + 0.1) / (10 + 0.1 * 4))
    assert short["base"] == pytest.approx(2 * log(5) + log(3) + log(2), rel=1e-14)
    assert (short["n_tokens"], short["n_known"], short["doc_id"]) == (6, 4, None)
    assert [(r["word"], r["tf"]) for r in rows if r["uid"] == 1 and r["salt"] == 0] == [(b"c", 2)]


def test_lm_tasks_make_no_python_call_for_each_word(monkeypatch):
    """Training and scoring go over whole arrays; word by word took some two fifths of their CPU seconds."""
    cfg = lm.LmConfig(groups=2, members=2, tail_classes=2, dim=2, noise=2, inner_noise=2)
    top, inner = np.array([0.7, 0.1, 0.1, 0.1]), np.full(4, 0.5)
    own, params = {b"": 0, b"a": 1}, lm.start(top, inner, cfg)
    model = lm.LanguageModel(cfg, None, 10, 3, 2, own, {b"a": 5, b"b": 3}, [(3, 1), (0, 0)], params)
    calls = []
    for name in ("words_of", "tail_class"):
        monkeypatch.setattr(lm, name, lambda *a, f=getattr(lm, name): calls.append(a) or f(*a))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([5, 6]), pa.array(["a b c " * 50, None])], ["uid", "doc_id", "text"])
    trained = list(lm._train_task(own, params, top, inner, cfg, 0)(iter([batch])))
    scored = pa.Table.from_batches(list(lm._score_task(model)(iter([batch])))).to_pylist()
    assert trained[0].column("seen")[0].as_py() == 152 and [r["n_tokens"] for r in scored if r["n_tokens"]] == [151, 1]
    assert not calls
