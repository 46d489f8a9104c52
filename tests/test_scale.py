"""Operators that replaced pair tables, buffers and copies: against brute force on small tables."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerline.config import METRICS
from ledgerline.operators import analogs, cohort, deid, merge, model, portfolio, replay
from ledgerline.plans import order, reuse, stages
from ledgerline.plans.reuse import scratch
from ledgerline.queries import base, portfolio_views, replaying, risk, scoring
from ledgerline.queries import files as file_queries
from ledgerline.sources import versions


def test_patience_picks_the_stage_of_a_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        losses = [rng.choice([1, 2, 3, 4, 5]) / 5 for _ in range(rng.randrange(1, 40))]
        patience = rng.randrange(1, 12)
        end = next((k for k in range(len(losses)) if k - losses.index(min(losses[: k + 1])) >= patience), None)
        seen = losses if end is None else losses[: end + 1]
        assert model.kept_stages(losses, patience) == (losses.index(min(seen)) + 1, end is not None)


@pytest.fixture(scope="module")
def parts(spark):
    return risk.trained(spark, SF)


def test_trees_stop_where_the_held_out_years_say(spark, parts):
    train, test = parts
    fitted = model.fit_trees(train, iterations=30, depth=3, patience=5)
    whole = model.fit_trees(train, iterations=30, depth=3, patience=30).losses
    assert fitted.losses == pytest.approx(whole[: len(fitted.losses)])  # more trees begin with the same ones
    own, late = model.validation(train)
    assert own.agg(F.max("fiscal_year")).first()[0] == 1995 and late.agg(F.min("fiscal_year")).first()[0] == 1996
    rows = PipelineModel(fitted.stages[:-1]).transform(model.balanced(model.doubles(late).fillna(fitted.fills), own)).select("features", "label", "weight").collect()
    y, w, trees = np.array([2 * r.label - 1 for r in rows]), np.array([r.weight for r in rows]), fitted.stages[-1]
    margin = np.zeros(len(rows))
    for k, (tree, share) in enumerate(zip(trees.trees, trees.treeWeights)):
        margin += share * np.array([tree.predict(r.features) for r in rows])
        assert fitted.losses[k] == pytest.approx((w * 2 * np.log1p(np.exp(-2 * y * margin))).sum() / w.sum())
    assert trees.getNumTrees == model.kept_stages(fitted.losses, 5)[0] == len(trees.trees)
    x = [r.x for r in model.score(test, fitted).select(vector_to_array("rawPrediction")[1].alias("x")).limit(20).collect()]
    vectors = PipelineModel(fitted.stages[:-1]).transform(model.doubles(test).fillna(fitted.fills)).select("features").limit(20).collect()
    assert x == pytest.approx([sum(t.predict(v.features) * s for t, s in zip(trees.trees, trees.treeWeights)) for v in vectors])


def test_trees_without_validation_years_use_all_rows(spark, parts):
    train, _ = parts
    fitted = model.fit_trees(train.where("fiscal_year = 1998"), iterations=4, depth=2)
    assert fitted.stages[-1].getNumTrees == 4


def test_global_drivers_match_numpy(spark, parts):
    train, test = parts
    fitted = model.fit_linear(train)
    scored = model.score(test, fitted).cache()
    x = np.array([r.x for r in scored.select(vector_to_array("features").alias("x")).collect()])
    want = defaultdict(float)
    for (_, source), k, column in zip(model.feature_names(fitted), fitted.stages[-1].coefficients.toArray(), x.T):
        want[source] += np.abs(column * k).mean()
    got = {r.feature: r.mean_abs_contribution for r in model.global_drivers(scored, fitted).collect()}
    assert set(got) == set(want) and all(got[f] == pytest.approx(want[f]) for f in got)
    assert model.global_drivers(scored.limit(0), fitted).count() == 0


def test_percentiles_of_several_columns(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.0, 3.5, None]), rng.random(), None) for _ in range(400)] + [("c", 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    shares = {"q25": 0.25, "q50": 0.5, "q90": 0.9}
    got = {r.g: r for r in order.percentiles_of(df.repartition(5), ["g"], {"x": "x_", "y": "y_", "z": "z_"}, shares).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile(c, q).alias(f"{c}_{n}") for c in "xyz" for n, q in shares.items()]).collect()}
    for g, w in want.items():
        for c in w.asDict():
            assert getattr(got[g], c) == (w[c] if c == "g" else pytest.approx(w[c]) if w[c] is not None else None)
    alone = order.percentiles(df, [], "y", shares).first()
    assert alone.q50 == pytest.approx(df.agg(F.percentile("y", 0.5)).first()[0])


def test_window_moments_of_large_means_with_little_spread(spark):
    rng = random.Random(5)
    rows = [(k, y, str(i), 1e9 + rng.random() * 1e-3, 7.0 if k == "flat" else rng.gauss(0, 1), None if rng.random() < 0.4 else 0.1) for k in ("a", "flat") for y in range(1995, 2002) if y != 1998 for i in range(40)]
    rows.append(("one", 2000, "x", 5.0, None, 0.1))
    df = spark.createDataFrame(rows, f"cohort_key string, fiscal_year int, ein string, {METRICS[0]} double, {METRICS[1]} double, {METRICS[2]} double")
    scored = df.where("fiscal_year IN (2000, 2001)")
    got = {(r.cohort_key, r.target_year): r for r in cohort.window_moments(df, cohort.targets(scored)).collect()}
    assert len(got) == 5
    for (key, year), r in got.items():
        for i, m in enumerate(METRICS):
            x = np.array([q[3 + i] for q in rows if q[0] == key and year - 6 <= q[1] <= year and q[3 + i] is not None], np.longdouble)
            s = r[f"s_{m}"]
            assert s.n == len(x)
            if len(x):
                assert (s.least, s.most) == (float(x.min()), float(x.max())) and s.mean == pytest.approx(float(x.mean()), rel=1e-15)
                assert s.m2 == pytest.approx(float(((x - x.mean()) ** 2).sum()), rel=1e-3, abs=1e-20)
    z = cohort.z_scores(scored, df).collect()
    assert all(r[f"z_{METRICS[1]}"] == 0 for r in z if r.cohort_key in ("flat",)) and all(r[f"z_{METRICS[2]}"] in (0, None) for r in z)
    assert all(abs(r[f"z_{METRICS[0]}"]) < 4 for r in z if r.cohort_key == "a") and np.std([r[f"z_{METRICS[0]}"] for r in z if r.cohort_key == "a"]) == pytest.approx(1, abs=0.2)
    assert all(r[f"z_{m}"] in (0, None) for r in z if r.cohort_key == "one" for m in METRICS)


def slow_improvements(targets, panel, top=3):
    need = {"operating_margin": 0.1, "deficit_runway": 6.0, "revenue_diversification_index": 0.2}
    out = {}
    for t in targets:
        if t["sector"] is None:
            continue
        metric = "revenue_diversification_index" if t["rdi"] < 0.3 else "deficit_runway" if t["runway"] < 12 else "operating_margin"
        same = [p for p in panel if p[0] != t["ein"] and p[2] == t["sector"]]
        near = [p for p in same if p[3] == t["state"] and t["own"] is not None and t["own"] > 0 and p[4] > 0 and t["own"] * 0.3 <= p[4] <= t["own"] * 3]
        found = []
        by = defaultdict(list)
        for p in near or same:
            by[p[0]].append((p[1], p[5] if metric == "deficit_runway" else p[6] if metric == "operating_margin" else p[7]))
        for peer, series in by.items():
            series.sort(reverse=True)
            for k in (5, 4, 3):
                if len(series) >= max(k, 4) and series[0][1] - series[k - 1][1] > need[metric]:
                    found.append((-round(series[0][1] - series[k - 1][1], 9), peer, f"FY{series[k - 1][0]}-FY{series[0][0]}"))
                    break
        out[t["ein"]] = [(peer, window) for _, peer, window in sorted(found)[:top]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_improvements_are_those_of_all_pairs(spark, seed):
    """Equal revenues and gains, bounds of the band met exactly, targets that are peers themselves or have no revenue."""
    rng = random.Random(seed)
    panel = []
    for e in range(70):
        sector, state = rng.choice(["A", "A", "B", None]), rng.choice("xy")
        for y in range(2000, 2000 + rng.randrange(1, 9)):
            panel.append((str(e), y, sector, state, float(rng.choice([30, 90, 100, 100, 300, 300, 1000, 3000, 0])), rng.choice([0.0, 5.0, 10.0, 20.0]), rng.choice([-0.3, -0.1, 0.0, 0.05, 0.2]), rng.choice([0.1, 0.2, 0.5, 0.6])))
    df = spark.createDataFrame(panel, "ein string, fiscal_year int, ntee_major_category string, state string, total_revenue double, deficit_runway double, operating_margin double, revenue_diversification_index double")
    targets = [{"ein": str(e) if e < 30 else f"t{e}", "sector": rng.choice(["A", "B", None, "C"]), "state": rng.choice("xyz"), "own": rng.choice([100.0, 100.0, 300.0, 1000.0, 33.0, 1e9, 0.0, None]), "rdi": rng.choice([0.2, 0.4]), "runway": rng.choice([1.0, 20.0])} for e in range(60)]
    t = spark.createDataFrame([(x["ein"], x["sector"], x["state"], x["own"], x["rdi"], x["runway"]) for x in targets], "ein string, ntee_major_category string, state string, total_revenue double, revenue_diversification_index double, operating_runway_proxy_months double")
    got = defaultdict(dict)
    for r in analogs.improvements(t, df).collect():
        got[r.target][r["rank"]] = (r.peer, r.recovery_window)
    want = slow_improvements(targets, panel)
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_nodes_cover_each_stretch_once(spark):
    ends = [(a, b) for a in range(1, 20) for b in range(a, 20)] + [(5, 100_000)]
    df = spark.createDataFrame(ends, "first long, last long").withColumn("n", analogs._nodes(F.col("first"), F.col("last")))
    for r in df.collect():
        held = sorted(p for x in r.n for p in range(x.node << x.level, (x.node + 1) << x.level))
        assert held == list(range(r.first, r.last + 1)) and len(r.n) <= 2 * 18


# --- versions, secrets, peers, search -------------------------------------------------------------------------------


def _rows(spark, rows):
    return spark.createDataFrame(rows, "ein string, period int, fiscal_year int, amount double, submitted string")


def fed():
    return F.col("submitted").isNotNull()


def _state(spark, path, version=None):
    return sorted((tuple(r) for r in versions.read(spark, path, version).collect()), key=str)


def test_a_batch_counts_once_and_rewrites_only_its_years(spark):
    path = scratch(spark)
    versions.create(path, _rows(spark, [("a", 1, 2000, 1.0, None), ("b", 1, 2000, 2.0, "x"), ("c", 2, 2001, 3.0, None), ("d", 3, 2002, 4.0, "x"), ("e", 9, None, 5.0, None)]), "fiscal_year")
    zero = versions.latest(spark, path)
    assert set(zero.parts) == {"2000", "2001", "2002", "none"} and zero.number == 0
    batch = _rows(spark, [("b", 1, 2000, 20.0, "y"), ("a", 1, 2000, 99.0, "y"), ("n", 7, 2003, 7.0, "y")])
    one = versions.ingest(path, batch, "m1", ["ein", "period"], fed())
    want = [("a", 1, 2000, 1.0, None), ("b", 1, 2000, 20.0, "y"), ("c", 2, 2001, 3.0, None), ("d", 3, 2002, 4.0, "x"), ("e", 9, None, 5.0, None), ("n", 7, 2003, 7.0, "y")]
    assert _state(spark, path) == sorted(want, key=str)
    assert all(one.parts[p] == zero.parts[p] for p in ("2001", "2002", "none")) and one.parts["2000"] != zero.parts["2000"]
    assert versions.ingest(path, batch, "m1", ["ein", "period"], fed()) == one and _state(spark, path) == sorted(want, key=str)  # fed twice
    moved = versions.ingest(path, _rows(spark, [("d", 3, 2000, 40.0, "z")]), "m2", ["ein", "period"], fed())  # its year was wrong
    assert set(moved.parts) == {"2000", "2001", "2003", "none"} and ("d", 3, 2000, 40.0, "z") in _state(spark, path)
    assert sum(r[0] == "d" for r in _state(spark, path)) == 1 and _state(spark, path, zero)[1][3] == 2.0  # older versions stay readable
    assert versions.read(spark, path, only={"2003"}).collect()[0].ein == "n"
    before = _state(spark, path)
    assert versions.vacuum(spark, path, keep=1) > 0 and _state(spark, path) == before
    more = versions.ingest(path, _rows(spark, [("q", 1, 2001, 1.0, "w")]).withColumn("extra", F.lit(1)), "m3", ["ein", "period"], fed())
    assert {r.ein: r.extra for r in versions.read(spark, path).collect()}["q"] == 1 and more.batches == ["m1", "m2", "m3"]
    assert versions.ingest(path, _rows(spark, []), "m4", ["ein", "period"], fed()).parts == more.parts


def test_a_merge_that_stops_half_way_leaves_the_table(spark, monkeypatch):
    path = scratch(spark)
    versions.create(path, _rows(spark, [("a", 1, 2000, 1.0, "x")]), "fiscal_year")
    batch, publish = _rows(spark, [("a", 1, 2000, 2.0, "y")]), versions._publish

    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(versions, "_publish", stop)
    with pytest.raises(RuntimeError, match="lost"):
        versions.ingest(path, batch, "m1", ["ein", "period"], fed())
    assert _state(spark, path) == [("a", 1, 2000, 1.0, "x")] and versions.latest(spark, path).batches == []
    monkeypatch.setattr(versions, "_publish", lambda s, p, v: (publish(s, p, v), publish(s, p, v)))
    with pytest.raises(versions.Conflict):  # somebody else publishes the same number
        versions.ingest(path, batch, "m1", ["ein", "period"], fed())
    monkeypatch.setattr(versions, "_publish", publish)
    assert versions.ingest(path, batch, "m1", ["ein", "period"], fed()).batches == ["m1"] and _state(spark, path) == [("a", 1, 2000, 2.0, "y")]
    assert versions.vacuum(spark, path, keep=2) == 1  # what the first attempt left


@pytest.mark.parametrize("anchors", [500_000, 0])
def test_secrets_are_found_like_by_all_runs(spark, monkeypatch, anchors):
    monkeypatch.setattr(deid, "ANCHORS", anchors)
    rng = random.Random(7)
    words = ["the", "house", "of", "hope", "art", "and", "x1"]
    secrets = [(f"k{i % 2}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(25)] + [("k0", "the the the"), ("k1", "..."), ("k0", None), ("k2", "The-House")]
    texts = [(i, ", ".join(rng.choice(words).upper() for _ in range(rng.randrange(0, 30)))) for i in range(40)] + [(98, None), (99, "nothing here")]
    s = spark.createDataFrame(secrets, "kind string, secret string").distinct()
    got = {(r.id, r.kind, r.secret) for r in deid.occurrences(spark.createDataFrame(texts, "id int, text string"), "id", "text", s).collect()}
    run = lambda t: [w for w in "".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split()]
    holds = lambda t, w: any(t[i : i + len(w)] == w for i in range(len(t) - len(w) + 1))
    want = {(i, k, w) for i, t in texts for k, w in set(secrets) if run(w) and holds(run(t), run(w))}
    assert got == want and len(want) > 50
    found = deid.occurrences(spark.createDataFrame(texts, "id int, text string"), "id", "text", s.limit(0))
    assert found.count() == 0 and set(found.columns) >= {"id", "kind", "secret"}


def test_three_peers_are_those_of_all_pairs(spark):
    rng = random.Random(11)
    rows = [(str(i), rng.choice("ab"), float(rng.choice([1, 2, 2, 2, 3, 5, 8, 8, 13])), 1995, 1995 + rng.randrange(1, 4), 0.0, rng.choice([0.1, 0.2, 0.3])) for i in range(60)] + [("solo", "z", 1.0, 1995, 1996, 0.0, 1.0), ("none", None, 1.0, 1995, 1996, 0.0, 1.0)]
    pool = spark.createDataFrame(rows, "peer string, g string, peer_revenue double, pre_year int, post_year int, pre_value double, post_value double")
    pairs = replay.peer_candidates(pool, ["g"])
    assert pairs.count() <= 13 * len(rows)
    got = {(r.target, r.role): r.peer for r in replay.three_peers(pairs).collect()}
    want = {}
    for t in rows:
        left = [p for p in rows if p[0] != t[0] and p[1] == t[1] and t[1]]
        for role, by in (("closest", lambda p: abs(p[2] / t[2] - 1)), ("fastest", lambda p: p[4] - p[3]), ("strongest", lambda p: -(p[6] - p[5]))):  # noqa: B023
            if left:
                best = min(left, key=lambda p: (by(p), p[0]))
                want[t[0], role] = best[0]
                left.remove(best)
    assert got == want


def test_indexed_search_finds_what_a_scan_finds(spark):
    rng = random.Random(13)
    rows = [(str(i), "".join(rng.choice("abAB é") for _ in range(rng.randrange(0, 9))) if i % 9 else None, rng.choice(["AM", None]), "B", rng.choice(["aab", "bba"]), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "ein string, org_name string, state string, ntee_major_category string, action_label string, fit_score double").cache()
    path = scratch(spark)
    portfolio.index_texts(df, path)
    postings = spark.read.parquet(path)
    for text in ("aab", "ABa", "b é", "abab", "zzz", "a", "", " Aab ", "aabbb"):
        for by in ("score", "score_up", "name"):
            scan = [r.ein for r in portfolio.search(df, text, by=by).collect()]
            assert sorted(r.ein for r in portfolio.search(df, text, by=by, postings=postings).collect()) == sorted(scan)
            assert set(scan) == {r[0] for r in rows if any(text.strip().lower() in (x or "").lower() for x in r[1:5])}
    names = [r.org_name for r in portfolio.search(df, "ab", by="name").collect()]
    known = [n.lower() for n in names if n is not None]
    assert known == sorted(known) and names[len(known) :] == [None] * (len(names) - len(known))


def test_margin_trend_and_match_rate(spark):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.1), ("b", 2, 0.105), ("c", 1, 0.2), ("c", 3, 0.1), ("d", 1, 0.2), ("e", 1, 0.1), ("e", 2, None)], "ein string, fiscal_year int, operating_margin double")
    assert {r.ein: r.margin_trend for r in portfolio.margin_trend(df).collect()} == {"a": "improving", "b": "stable", "c": "declining", "d": None, "e": None}
    rows = spark.createDataFrame([("a", "X"), ("a", None), ("b", None), (None, "X")], "ein string, sector string")
    assert tuple(merge.match_rate(rows, "ein").first()) == (2, 1, 0.5) and tuple(merge.match_rate(rows.limit(0), "ein").first()) == (0, 0, None)


def test_analogs_are_searched_only_where_counts_leave_it_open(spark):
    peers = spark.createDataFrame([("m", "s", x, y, f"p{i}", 1.0 + i) for i in range(4) for x in ("A", "*") for y in ("AF", "*")] + [("m", "s", x, y, "q", 9.0) for x in ("B", "*") for y in ("EU", "*")], "metric string, size_bucket string, sector string, state string, peer string, peer_revenue double")
    t = spark.createDataFrame([("t1", "A", "AF"), ("t2", "A", "EU"), ("t3", "B", "EU"), ("t4", "C", None)], "target string, sector string, home string").withColumns({"metric": F.lit("m"), "size_bucket": F.lit("s"), "total_revenue": F.lit(1.0)})
    got = sorted(tuple(r) for r in analogs._searches(t, peers, ["metric", "size_bucket", "sector", "state"], 3).select("target", "sector", "state").collect())
    assert got == [("t1", "A", "AF"), ("t2", "A", "*"), ("t3", "*", "*"), ("t3", "*", "EU"), ("t3", "B", "*"), ("t3", "B", "EU"), ("t4", "*", "*")]


def test_filings_lie_in_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(file_queries, "FILINGS", 10)
    files_ = spark.read.format("binaryFile").load(file_queries.xml(spark, SF)).select("length").collect()
    assert len(files_) >= 15 and max(r.length for r in files_) < 10_000
    assert file_queries.s05(spark, SF).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_features_are_made_and_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(risk, "cut", lambda df: written.append(df) or reuse.cut(df))
    train, test = risk.trained(spark, SF)
    assert len(written) == 1 and train.count() > 0 and test.count() > 0
    written.clear()
    plan = risk.d14(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and "lineitem" not in plan and "l_orderkey" not in plan


def test_drivers_meet_no_shuffle(spark):
    train, test = risk.trained(spark, SF)
    fitted = model.fit_linear(train)
    scored = model.score(test, fitted)
    got = model.drivers(scored, fitted)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    names, w = model.feature_names(fitted), fitted.stages[-1].coefficients.toArray()
    want = {}
    for r in scored.select("ein", "fiscal_year", vector_to_array("features").alias("x")).collect():
        parts = defaultdict(float)
        for (_, feature), x, c in zip(names, r.x, w):
            parts[feature] += x * c
        best = sorted((-p, f) for f, p in parts.items() if p > 0)[:3]
        if best:
            want[r.ein, r.fiscal_year] = [f for _, f in best]
    assert {(r.ein, r.fiscal_year): [x.split(" ")[0] for x in r.drivers.split("; ")] for r in got.collect()} == want


def test_alignment_makes_the_panel_once(spark, monkeypatch):
    made = []
    panel = portfolio_views.panel
    monkeypatch.setattr(portfolio_views, "panel", lambda *a: made.append(1) or panel(*a))
    out = portfolio_views.x32(spark, SF)
    assert len(made) == 1 and "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_improvement_analogs_make_the_panel_once(spark, monkeypatch):
    made, panel = [], scoring.tp.panel
    monkeypatch.setattr(scoring.tp, "panel", lambda *a: made.append(1) or panel(*a))
    written = []
    for where in (scoring, analogs, order):
        monkeypatch.setattr(where, "cut", lambda df: written.append(df) or reuse.cut(df))
    out = scoring.e12(spark, SF)
    assert len(made) == 1
    read = [df for df in written if "l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString()]
    assert len(read) == 1 and "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()


def _never(*_, **__):
    raise AssertionError("this step is not needed here")


@pytest.mark.parametrize("query", [portfolio_views.x11b, scoring.e10])
def test_analogs_alone_need_no_scores_and_few_columns(spark, monkeypatch, query):
    for where, name in ((stages.cohort, "z_scores"), (stages.cohort, "confidence"), (stages.stress, "shocks")):
        monkeypatch.setattr(where, name, _never)
    wide, cut = [], stages.cut
    monkeypatch.setattr(stages, "cut", lambda df: wide.append("pct_contributions" in df.columns) or cut(df))
    assert query(spark, SF).count() > 0 and sum(wide) == 1  # the panel


def test_portfolio_rows_need_no_analogs_trend_or_memo(spark, monkeypatch):
    for where, name in ((analogs, "match"), (analogs, "pool"), (stages.labels, "trend"), (stages.labels, "memo")):
        monkeypatch.setattr(where, name, _never)
    assert scoring.l08(spark, SF).count() > 0


def test_labels_write_wide_rows_three_times(spark, monkeypatch):
    wide, cut = [], stages.cut
    monkeypatch.setattr(stages, "cut", lambda df: wide.append("pct_contributions" in df.columns and not getattr(df, reuse._CUT, False)) or cut(df))
    assert scoring.l07(spark, SF).first().longest > 0 and sum(wide) == 3  # the panel, its eligible rows, the scored rows


def test_a_batch_leaves_the_partitions_of_other_sources(spark, monkeypatch):
    path = scratch(spark)
    monkeypatch.setattr(base, "scratch", lambda _: path)
    assert base.u12(spark, SF).count() > 0
    first, last = versions.latest(spark, path, 0), versions.latest(spark, path)
    assert last.batches == ["2003-01", "2003-02"] and set(first.parts) == set(last.parts)
    kept = {p for p in first.parts if first.parts[p] == last.parts[p]}
    assert kept >= {p for p in first.parts if p.endswith("own")} and len(kept) < len(first.parts)


def test_a_batch_row_of_an_own_key_in_another_partition_is_left_out(spark):
    path = scratch(spark)
    versions.create(path, _rows(spark, [("a", 1, 2000, 1.0, None), ("b", 1, 2001, 2.0, "x"), ("b", 2, 2002, 2.0, "x")]), "fiscal_year")
    zero = versions.latest(spark, path)
    one = versions.ingest(path, _rows(spark, [("a", 1, 2003, 9.0, "y"), ("b", 1, 2004, 8.0, "y")]), "m1", ["ein", "period"], fed())
    assert _state(spark, path) == [("a", 1, 2000, 1.0, None), ("b", 1, 2004, 8.0, "y"), ("b", 2, 2002, 2.0, "x")]
    assert all(one.parts[p] == zero.parts[p] for p in ("2000", "2002")) and "2003" not in one.parts and "2001" not in one.parts


def test_every_call_has_its_narrative(spark, monkeypatch):
    """More calls than the million that the query once stopped at; the strongest are still 30."""
    n = 1_000_010
    called = spark.range(n).selectExpr("cast(id AS string) AS ein", "2000 AS fiscal_year", "'AF' AS state", "'A' AS ntee_major_category", "0.5 AS proba", "4.0 AS shock_absorption_months")
    later = spark.range(n).selectExpr("cast(id AS string) AS ein", "explode(array(2000, 2001)) AS fiscal_year", "id / 1e6 AS cash_runway_months", "-1.0 AS operating_margin_pct")
    monkeypatch.setattr(replaying, "calls", lambda *_: called)
    monkeypatch.setattr(replaying, "panel", lambda *_: later)
    told = replaying.r08(spark, SF)
    assert told.agg(F.count("narrative"), F.countDistinct("ein")).first() == (n, n)
    assert [r.ein for r in replaying.r06(spark, SF).collect()] == [str(k) for k in range(30)]
