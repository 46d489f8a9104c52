"""Small fixtures and properties for the panel operators; every registered query with an oracle is compared on sf0.001."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerline import registry
from ledgerline.functions import metrics as m
from ledgerline.functions import text as t
from ledgerline.operators import analogs, deid, evaluate, features, labels, model, portfolio, profile, replay, score, stress
from ledgerline.plans import order
from ledgerline.queries import risk


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{v:.8g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


FAST = [k for k in registry.ORACLES if k[0] in "cuqm" or k in ("b02_cohort_fallback", "b05_q75_median", "e01_shock_scenarios", "e07_recovery_pool", "d03_forward_target", "d06_deficit_streak", "x02_income_streak", "s05_filing_xml", "s07_parquet_sink", "a01_stable_hash", "a02_aliases", "a04_money_jitter")]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(norm(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=str)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lags_target_and_growth(spark):
    rows = [("100", 2018, 1e6, 9e5, 200.0), ("100", 2019, 1.2e6, 1e6, 200.0), ("100", 2020, 1e6, 1.1e6, 200.0), ("200", 2018, 1.0, 1.0, 1.0), ("200", 2020, 1.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "ein string, fiscal_year int, total_revenue double, total_expenses double, cash double")
    df = df.withColumns({"operating_margin": m.operating_margin(), "shock_absorption_months": F.col("cash") / (F.col("total_expenses") / 12)})
    got = {(r.ein, r.fiscal_year): r for r in features.target(features.growth(features.lags(df))).collect()}
    a = got["100", 2019]
    assert a.operating_margin_lagged_1y == pytest.approx(0.1) and a.revenue_growth_yoy == pytest.approx(0.2) and a.target == 1
    assert got["100", 2020].target is None and got["200", 2018].target is None  # 2019 is missing


def test_label_thresholds(spark):
    def row(mix, margin=0.1, runway=0.1, tier="High", urgency="none", severe="none", status="ok", gap=0.0):
        return (margin, runway, mix, tier, urgency, severe, status, gap)

    rows = [row(-0.31), row(-0.29), row(0.1), row(0.1, tier="Low"), row(-0.31, margin=-0.31), row(0.1, status="insufficient_resilient_refs", gap=2.5), (None, None, None, "High", "none", None, "ok", None)]
    df = spark.createDataFrame(rows, "operating_margin_gap double, operating_runway_gap double, revenue_diversification_gap double, checkpoint1_confidence_tier string, urgency_severity string, stress_25pct_severity string, benchmark_status string, resilience_gap double")
    got = labels.label(df).collect()
    assert [r.action_label for r in got] == ["Revenue Concentration Risk", "Weak Financial Foundation", "Underinvested Asset Base", "Needs Data Diligence", "Weak Financial Foundation", "Needs Data Diligence", "Weak Financial Foundation"]
    assert got[5].action_label_rationale == ["review_insufficient_resilient_refs", "review_structural_outlier"]
    assert got[1].action_label_rationale[1] == "stabilize_primary_constraint_high_concentration_in_volatile_source"


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("THE HOUSE OF HOPE AND ART-CENTER II", 1234567.0), ("UFCW of WA", 12.0)], "n string, x double")
    got = df.select(t.title_case(F.col("n")).alias("n"), t.compact_currency(F.col("x")).alias("x")).collect()
    assert got[0].n == "The House of Hope and Art-Center II" and got[1].n == "UFCW of WA" and [r.x for r in got] == ["$1.2M", "$12"]


def test_quotas_fill_and_respect_capacity(spark):
    rows = [("Needs Data Diligence", k, i) for k, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "action_label string, constraint string, i int")
    got = {r.constraint: r.quota for r in portfolio.quotas(df, {"Needs Data Diligence": 30}).collect()}
    assert sum(got.values()) == 30 and got["c"] == 1 and got["b"] <= 3


def test_severity_order(spark):
    df = spark.createDataFrame([(100.0, 90.0, -1.0, 5.0, 5.0), (100.0, 200.0, 10.0, 1.0, 1.0), (100.0, 50.0, 10.0, None, 1.0)], "total_revenue double, total_expenses double, net_assets_eoy double, cash_non_interest_bearing double, savings_temporary_investments double")
    for s in ("contributions_grants", "program_service_revenue", "investment_income", "other_revenue"):
        df = df.withColumn(s, F.lit(25.0))
    got = stress.shocks(df).collect()
    assert [r.stress_25pct_severity for r in got] == ["critical", "critical", None] and got[0].largest_revenue_source == "contributions"


def test_analogs_rank_ties_like_brute_force(spark):
    """Equal revenues, few peers of the state, targets among their own peers, targets without revenue."""
    import random

    rng = random.Random(4)
    peers = [(m_, str(i), 1996, 0.1, 1998 + rng.randrange(4), 0.9, rng.choice("AB"), f"n{i}", rng.choice(["X", "X", "Y", None]), "s", float(rng.choice([100, 100, 100, 120, 80, 300]))) for i, m_ in enumerate(["operating_margin"] * 120)]
    peers += [("operating_margin", str(200 + i), 1996, 0.1, 1999, 0.9, "C", "n", "Z", "s", 500.0) for i in range(30)]
    pool = spark.createDataFrame(peers, "metric string, peer string, pre_year int, pre_value double, post_year int, post_value double, peer_state string, peer_name string, peer_sector string, size_bucket string, peer_revenue double")
    rows = [(str(k), 2001, "ok", -0.5, None, None, "s", rng.choice([100.0, 110.0, 80.0, 400.0, None, -5.0]), rng.choice("ABD"), rng.choice(["X", "Y", "W", None])) for k in range(60)]
    rows.append(("201", 2001, "ok", -0.5, None, None, "s", 500.0, "C", "Z"))
    scored = spark.createDataFrame(rows, "ein string, fiscal_year int, benchmark_status string, operating_margin_gap double, operating_runway_gap double, revenue_diversification_gap double, size_bucket string, total_revenue double, state string, ntee_major_category string")
    got = {}
    for r in analogs.match(scored, pool).collect():
        got.setdefault(r.ein, {})[r["rank"]] = r.peer
    for ein, *_, revenue, state, sector in [(x[0], *x[7:]) for x in rows]:
        others = [p for p in peers if p[1] != ein]
        strict = [p for p in others if sector and p[8] == sector]
        key = lambda p: (p[6] != state, abs(p[10] / revenue - 1) if revenue and revenue > 0 else 0, -p[4], int(p[1]))  # noqa: E731, B023
        assert [got[ein][k] for k in sorted(got[ein])] == [p[1] for p in sorted(strict or others, key=key)[:3]]
    assert got["201"] == {1: "200", 2: "202", 3: "203"}


def test_order_statistics_and_running_sums(spark):
    rows = [("a" if i % 3 else "b", float(i * 7 % 50), 1) for i in range(200)] + [("a", None, 1), ("c", 5.0, 1)]
    df = spark.createDataFrame(rows, "g string, x double, one int")
    want = {(r.g): (r.q, r.m) for r in df.groupBy("g").agg(F.percentile("x", 0.25).alias("q"), F.percentile("x", 0.8).alias("m")).collect()}
    got = {r.g: (r.q, r.m) for r in order.percentiles(df, ["g"], "x", {"q": 0.25, "m": 0.8}).collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    placed = order.running(df.where("x is not null").withColumn("i", F.monotonically_increasing_id()), ["g"], ["x", "i"], {"n": F.lit(1)}).collect()
    for g in "abc":
        mine = sorted((r.n, r.x) for r in placed if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)


@pytest.fixture(scope="module")
def linear(spark):
    train, test = risk.trained(spark, SF)
    fitted = model.fit_linear(train)
    return train, test, fitted, model.score(test, fitted).cache()


def matrix(df, *columns):
    from pyspark.ml.functions import vector_to_array

    rows = df.select(vector_to_array("features").alias("x"), *columns).collect()
    return (np.array([r.x for r in rows]), *[np.array([r[c] for r in rows]) for c in columns])


def test_linear_model_matches_a_numpy_refit(spark, linear):
    """Newton steps on the same vectors, class weights and penalty (in units of each column's deviation)."""
    train, test, fitted, scored = linear
    data = model.balanced(model.doubles(train).fillna(fitted.fills))
    x, y, w = matrix(fitted.transform(data), "label", "weight")
    mean = (w[:, None] * x).sum(0) / w.sum()
    dev = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
    dev = np.where(dev > 0, dev, 1)
    z = np.hstack([x / dev, np.ones((len(x), 1))])
    b, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 1e-4), 0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        g = z.T @ (w * (p - y)) / w.sum() + penalty * b
        h = (z * (w * p * (1 - p))[:, None]).T @ z / w.sum() + np.diag(penalty + 1e-9)
        b -= np.linalg.solve(h, g)
    xt, proba = matrix(scored, "proba")
    assert np.abs(1 / (1 + np.exp(-(xt / dev) @ b[:-1] - b[-1])) - proba).max() < 0.02


def test_drivers_coefficients_and_scores_match_numpy(spark, linear):
    _, test, fitted, scored = linear
    coefficient, names = fitted.stages[-1].coefficients.toArray(), model.feature_names(fitted)
    x, proba, ein, year = matrix(scored, "proba", "ein", "fiscal_year")
    assert np.allclose(1 / (1 + np.exp(-(x @ coefficient + fitted.stages[-1].intercept))), proba)
    got = {(r.ein, r.fiscal_year): r.drivers for r in model.drivers(scored, fitted).collect()}
    for row, e, y in zip(x, ein, year):
        part = {}
        for (_, source), v, k in zip(names, row, coefficient):
            part[source] = part.get(source, 0) + v * k
        best = [(s, p) for s, p in sorted(part.items(), key=lambda t: (-t[1], t[0]))[:3] if p > 0]
        text = got.get((e, int(y)), "")
        assert [t.split(" (+")[0] for t in text.split("; ") if t] == [s for s, _ in best]
        assert all(abs(float(t.split("(+")[1][:-1]) - p) <= 0.0051 for t, (_, p) in zip(text.split("; "), best))
    table = model.coefficients(spark, fitted).collect()
    assert [r["name"] for r in table] == [names[i][0] for i in sorted(range(len(names)), key=lambda i: -abs(coefficient[i]))] and len(names) == x.shape[1]


def test_trees_learn_stop_early_and_sum_importances(spark, linear):
    train, test, *_ = linear
    fitted = model.fit_trees(train, iterations=60)
    assert fitted.stages[-1].getNumTrees <= 60
    area = evaluate.areas(evaluate.by_score(model.score(train.where("target is not null"), fitted))).first()
    assert area.roc_auc > 0.8
    shares = {r.feature: r.importance for r in model.importances(spark, fitted).collect()}
    assert sum(shares.values()) == pytest.approx(1) and set(shares) == {*features.NUMERIC, *features.CATEGORICAL}


def test_scrub_and_audit_reach_every_name(spark):
    texts = spark.createDataFrame([(1, "ACME, Inc. and Acme inc met 12345678 at AcmeInc; nan nanometres"), (2, None), (3, "nothing"), (4, "x Green House y GREEN house 1,234,567")], "id int, text string")
    secrets = spark.createDataFrame([("name", "Acme Inc.", "Case 01"), ("name", "Green House", "Case 02"), ("name", "House", "Case 03"), ("id", "12345678", "REDACTED-EIN")], "kind string, secret string, replacement string")
    got = {r.id: r.text for r in deid.scrub(texts, "id", "text", secrets).collect()}
    assert got == {1: "Case 01. and Case 01 met REDACTED-EIN at AcmeInc; not available nanometres", 2: None, 3: "nothing", 4: "x Case 02 y Case 02 1,234,567"}
    every = secrets.select("kind", "secret").unionByName(deid.amounts(spark.createDataFrame([(1234567.2, 5.0)], "a double, b double"), ["a", "b"]))
    assert {r.kind: (r.secrets, r.texts) for r in deid.leak_audit(texts, "id", "text", every).collect()} == {"name": (3, 2), "id": (1, 1), "amount": (1, 1)}
    clean = deid.scrub(texts, "id", "text", secrets)
    assert {r.kind: r.secrets for r in deid.leak_audit(clean, "id", "text", every.where("kind != 'amount'")).collect()} == {"name": 0, "id": 0}


def test_contract_and_calibration_by_rank(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None, None), ("b", 1, float("inf"), 1.0, None), (None, 1, 9.0, 1.0, 2.0)], "k string, y int, x double, p double, q double")
    source = spark.createDataFrame([("a", 1), ("z", 1)], "k string, y int")
    got = {r.check: r.violations for r in profile.contract(df, ["k", "gone"], ["x"], ["p", "q"], {"x": (0, 5)}, source, ["k", "y"]).collect()}
    assert got == {"null_key": 1, "not_finite": 1, "partly_null": 1, "range_x": 2, "missing_columns": 1, "row_count": 1, "keys_lost": 1, "keys_added": 2}
    rows = [(0.1,)] * 5 + [(0.2 + i / 100,) for i in range(15)]
    bins = evaluate.calibration_by_rank(spark.createDataFrame([(p, 1) for (p,) in rows], "proba double, target int"), bins=4).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in bins] == [(0, 5), (1, 5), (2, 5), (3, 5)]


def test_formats_round_the_exact_value_as_sql_does(spark):
    values = [198500.0, 297500.0, 199500.0, 198550.0, 1.25e6, 1.35e6, 2.5e9 + 5e7, 1500.0, 200000.0]
    c = duckdb.connect()
    for v in values:
        x, y = spark.range(1).select(t.compact_currency(F.lit(v)), t.signed((F.lit(v) - 200000) / 1e5)).first()
        unit, digits, letter = (1e9, 1, "B") if v >= 1e9 else (1e6, 1, "M") if v >= 1e6 else (1e3, 0, "K")
        assert x == c.execute(f"SELECT '$' || format('{{:.{digits}f}}', ?::DOUBLE / {unit}) || '{letter}'", [v]).fetchone()[0]
        assert y == c.execute("SELECT CASE WHEN v < 0 THEN '' ELSE '+' END || format('{:.2f}', v) FROM (SELECT (?::DOUBLE - 200000) / 1e5 AS v)", [v]).fetchone()[0]


def test_memo_and_narrative_numbers_take_ties_to_the_even_digit(spark):
    row = spark.createDataFrame([(0.125, -0.375, None)], "a double, b double, none double")
    assert row.select(t.number(F.col("a")), t.number(F.col("b")), t.number(F.col("none"), 2, "N/A")).first()[:] == ("0.12", "-0.38", "N/A")
    call = spark.createDataFrame([("AF", "B", 1999, 0.125, 2.25, None)], "state string, ntee_major_category string, fiscal_year int, proba double, t_plus_min_runway double, t_plus_min_margin double")
    assert call.select(replay.narrative()).first()[0] == "AF, sector B: called in FY1999 at 12%. Least runway after it: 2.2 months."
    assert spark.range(1).select(replay.outcome(F.lit(2000), F.lit(-0.25), F.lit(0.75))).first()[0] == "FY2000: margin -0.2%, runway 0.8mo"


def test_margin_move_is_subtracted_before_it_is_scaled(spark):
    pairs = [(a / 1000, (a - 80) / 1000) for a in range(-200, 300, 7)] + [(a / 1000, (a + 80) / 1000) for a in range(-200, 300, 7)]
    rows = [(str(i), y, m_) for i, pair in enumerate(pairs) for y, m_ in enumerate(pair)]
    assert any((b - a) * 100 < -8 and not b * 100 - a * 100 < -8 for a, b in pairs)
    got = dict(portfolio.margin_pattern(spark.createDataFrame(rows, "ein string, fiscal_year int, operating_margin double")).collect())
    assert got == {str(i): "improving" if (b - a) * 100 > 8 else "softer" if (b - a) * 100 < -8 else "steady" for i, (a, b) in enumerate(pairs)}


def test_protection_rounds_as_sql_does(spark):
    values = [round(k / 10000, 6) * 100 for k in range(105, 9900, 10)]
    rows = spark.createDataFrame([(v,) for v in values], "risk_pct double")
    want = [r[0] for r in duckdb.sql(f"SELECT round(greatest(0, 100 - v), 1) FROM (SELECT unnest({values}::DOUBLE[]) AS v)").fetchall()]
    assert [r[0] for r in rows.select(score.protection()).collect()] == want
    assert [r[0] for r in rows.select(F.round(100 - F.col("risk_pct"), 1)).collect()] != want
