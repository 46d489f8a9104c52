"""Features, models and evaluation (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import metrics as m
from ledgerline.operators import evaluate, features, merge, model
from ledgerline.plans import stages
from ledgerline.plans import testpanel as tp
from ledgerline.plans.oracle import add
from ledgerline.plans.reuse import cut
from ledgerline.queries.base import DEFICIT, LARGEST
from ledgerline.registry import query

KEY = ["ein", "fiscal_year"]
r6 = lambda c: F.round(c, 6).alias(c)

_W = "(PARTITION BY ein ORDER BY fiscal_year)"
_LAG = lambda c, k=1: f"lag({c}, {k}) OVER {_W}"
add(
    "frame",
    f"""SELECT *, CASE WHEN neg THEN sum(CAST(neg AS INT)) OVER (PARTITION BY ein, island ORDER BY fiscal_year) ELSE 0 END AS years_of_consecutive_deficits, largest_source_pct - {_LAG('largest_source_pct')} AS concentration_yoy_delta FROM (
      SELECT *, {_LAG('operating_margin')} AS m1, {_LAG('operating_margin', 2)} AS m2, {_LAG('total_revenue')} AS r1, {_LAG('total_expenses')} AS e1, {_LAG('shock_absorption_months')} AS s1, coalesce(operating_margin < 0, false) AS neg,
        sum(CASE WHEN coalesce(operating_margin < 0, false) THEN 0 ELSE 1 END) OVER {_W} AS island, {DEFICIT} AS cash_runway_months, CASE WHEN abs(total_revenue) > 1e-6 THEN least(greatest({LARGEST} / total_revenue, 0.0), 1.5) END AS largest_source_pct,
        count(*) OVER (PARTITION BY ein) AS years_of_data FROM metrics)""",
    "metrics",
)
add("targeted", "SELECT f.*, CASE WHEN n.operating_margin IS NOT NULL AND n.shock_absorption_months IS NOT NULL THEN CAST(n.shock_absorption_months < 3 AND n.operating_margin < 0 AS INT) END AS target FROM frame f LEFT JOIN metrics n ON n.ein = f.ein AND n.fiscal_year = f.fiscal_year + 1", "frame", "metrics")
add("risk", "SELECT *, round(least(greatest(0.5 - 2 * coalesce(operating_margin, 0) + (6 - least(coalesce(shock_absorption_months, 0), 12)) / 20, 0.01), 0.99), 6) AS proba FROM targeted WHERE target IS NOT NULL", "targeted")
add("test", "SELECT *, round(least(greatest(proba * 0.5 + largest_source_pct / 2, 0.01), 0.99), 6) AS proba2 FROM risk WHERE fiscal_year >= 1999", "risk")


def measured(spark, d):
    return m.with_metrics(merge.latest_filing(tp.panel(spark, d)))


@query("d01_lags", "SELECT ein, fiscal_year, round(m1, 6) AS operating_margin_lagged_1y, r1 AS total_revenue_lagged_1y, e1 AS total_expenses_lagged_1y, round(s1, 6) AS shock_absorption_months_lagged_1y FROM frame", "frame")
def d01(spark, d):
    return features.lags(measured(spark, d)).select(*KEY, r6("operating_margin_lagged_1y"), "total_revenue_lagged_1y", "total_expenses_lagged_1y", r6("shock_absorption_months_lagged_1y"))


@query("d02_growth", "SELECT ein, fiscal_year, round((total_revenue - r1) / nullif(r1, 0), 6) AS revenue_growth_yoy, round((total_expenses - e1) / nullif(e1, 0), 6) AS expense_growth_yoy, round(operating_margin - m1, 6) AS margin_change_yoy FROM frame", "frame")
def d02(spark, d):
    return features.growth(features.lags(measured(spark, d))).select(*KEY, r6("revenue_growth_yoy"), r6("expense_growth_yoy"), r6("margin_change_yoy"))


@query("d03_forward_target", "SELECT ein, fiscal_year, target FROM targeted", "targeted")
def d03(spark, d):
    return features.target(measured(spark, d)).select(*KEY, "target")


@query("d04_history_filter", "SELECT ein, fiscal_year, years_of_data FROM frame WHERE years_of_data >= 5", "frame")
def d04(spark, d):
    return features.history(measured(spark, d)).select(*KEY, F.col("years_of_data").cast("long").alias("years_of_data"))


@query("d05_slope", "SELECT ein, fiscal_year, round(CASE WHEN m1 IS NOT NULL THEN (operating_margin - m2) / 2 END, 6) AS margin_3yr_trend FROM frame", "frame")
def d05(spark, d):
    return features.slope(measured(spark, d)).select(*KEY, r6("margin_3yr_trend"))


@query("d06_deficit_streak", "SELECT ein, fiscal_year, CAST(years_of_consecutive_deficits AS BIGINT) AS streak FROM frame", "frame")
def d06(spark, d):
    return features.deficit_streak(measured(spark, d)).select(*KEY, F.col("years_of_consecutive_deficits").cast("long").alias("streak"))


@query("d07_concentration", "SELECT ein, fiscal_year, round(largest_source_pct, 6) AS largest_source_pct, round(concentration_yoy_delta, 6) AS concentration_yoy_delta FROM frame", "frame")
def d07(spark, d):
    return features.concentration(measured(spark, d)).select(*KEY, r6("largest_source_pct"), r6("concentration_yoy_delta"))


@query(
    "d08_interactions",
    """SELECT ein, fiscal_year, round(largest_source_pct / greatest(cash_runway_months, 1), 6) AS concentration_x_thin_runway, round(operating_margin * cash_runway_months, 6) AS margin_x_runway, round(years_of_consecutive_deficits * largest_source_pct, 6) AS negative_margin_years_x_concentration,
       CAST(coalesce(net_assets_eoy < 2e6 AND cash_runway_months < 6, false) AS INT) AS small_and_thin, CAST(coalesce(net_assets_eoy > 2e7 AND operating_margin < -0.1, false) AS INT) AS large_and_negative_margin,
       CAST(coalesce(ntee_major_category IN ('L', 'B', 'P') AND pct_contributions >= 0.7, false) OR coalesce(ntee_major_category = 'E' AND pct_program_revenue >= 0.8, false) AS INT) AS is_government_funded FROM frame""",
    "frame",
)
def d08(spark, d):
    df = features.interactions(features.concentration(features.deficit_streak(measured(spark, d))))
    return df.select(*KEY, r6("concentration_x_thin_runway"), r6("margin_x_runway"), r6("negative_margin_years_x_concentration"), "small_and_thin", "large_and_negative_margin", "is_government_funded")


@query(
    "d09_lookup_flags",
    """SELECT ein, fiscal_year, CAST(coalesce((ntee_major_category, fiscal_year) IN (('B', 1996), ('B', 1997), ('M', 2000)), false) AS INT) AS sector_budget_shock, CAST((state, fiscal_year) IN (('AF', 1998), ('EU', 1999)) AS INT) AS state_fiscal_stress,
       CAST(fiscal_year IN (1999, 2000) AS INT) AS covid_era, CASE WHEN fiscal_year < 1997 THEN 'a' WHEN fiscal_year < 1999 THEN 'b' ELSE 'post-covid 2023+' END AS fiscal_year_bucket FROM panel""",
    "panel",
)
def d09(spark, d):
    shocks = spark.createDataFrame([("B", 1996), ("B", 1997), ("M", 2000)], "ntee_major_category string, fiscal_year int")
    states = spark.createDataFrame([("AF", 1998), ("EU", 1999)], "state string, fiscal_year int")
    return features.lookups(tp.panel(spark, d), shocks, states, covid=(1999, 2000), eras=((1997, "a"), (1999, "b"))).select(*KEY, "sector_budget_shock", "state_fiscal_stress", "covid_era", "fiscal_year_bucket")


def frame(spark, d):
    return features.model_frame(measured(spark, d), 1)


@query(
    "d10_temporal_split",
    "SELECT CASE WHEN fiscal_year <= 1998 THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(target) AS positives FROM risk GROUP BY 1 UNION ALL SELECT CASE WHEN fiscal_year <= 1995 THEN 'fit' ELSE 'validation' END, count(*), sum(target) FROM risk WHERE fiscal_year <= 1998 GROUP BY 1",
    "risk",
)
def d10(spark, d):
    train, test = trained(spark, d)
    fit, late = model.validation(train)
    side = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.sum("target").alias("positives"))
    return side(train, "train").unionByName(side(test, "test")).unionByName(side(fit, "fit")).unionByName(side(late, "validation"))


def trained(spark, d):
    """Rows of known target up to the last training year, and those of the test years: the features are made and written once."""
    return model.split(cut(frame(spark, d).where("target IS NOT NULL")))


NUMBERS = {
    "operating_margin": "operating_margin", "shock_absorption_months": "shock_absorption_months", "revenue_diversification_index": "revenue_diversification_index",
    "cash_to_expenses": "(coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0)) / nullif(total_expenses, 0)", "revenue_to_expenses": "total_revenue / nullif(total_expenses, 0)",
    "net_assets_to_expenses": "net_assets_eoy / nullif(total_expenses, 0)", "operating_margin_lagged_1y": "m1", "shock_absorption_months_lagged_1y": "s1", "revenue_growth_yoy": "(total_revenue - r1) / nullif(r1, 0)",
    "expense_growth_yoy": "(total_expenses - e1) / nullif(e1, 0)", "margin_change_yoy": "operating_margin - m1", "margin_3yr_trend": "CASE WHEN m1 IS NOT NULL THEN (operating_margin - m2) / 2 END",
    "years_of_consecutive_deficits": "CAST(years_of_consecutive_deficits AS DOUBLE)", "largest_source_pct": "largest_source_pct", "cash_runway_months": "cash_runway_months",
}
add("numbers", " UNION ALL ".join(f"SELECT '{n}' AS feature, {x} AS value FROM risk WHERE fiscal_year <= 1998" for n, x in NUMBERS.items()), "risk")
add("medians", "SELECT feature, median(value) AS median FROM numbers GROUP BY feature", "numbers")


@query("d11_statistics", "SELECT feature, round(any_value(median), 5) AS median, round(avg(coalesce(value, median)), 5) AS mean, round(stddev_samp(coalesce(value, median)), 5) AS deviation FROM numbers JOIN medians USING (feature) GROUP BY feature", "numbers", "medians")
def d11s(spark, d):
    return model.statistics(trained(spark, d)[0]).select("feature", *[F.round(x, 5).alias(x) for x in ("median", "mean", "deviation")])


@query("d11_modes", "SELECT feature, value FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS r FROM (SELECT 'state' AS feature, state AS value, count(*) AS n FROM risk WHERE fiscal_year <= 1998 GROUP BY 2 UNION ALL SELECT 'ntee_major_category', ntee_major_category, count(*) FROM risk WHERE fiscal_year <= 1998 AND ntee_major_category IS NOT NULL GROUP BY 2)) WHERE r = 1", "risk")
def d11m(spark, d):
    train, _ = trained(spark, d)
    known = model.fills(train)
    return train.limit(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(known[n]).alias("value")) for n in ("state", "ntee_major_category")])))


add("scales", "SELECT feature, any_value(median) AS median, avg(coalesce(value, median)) AS mean, stddev_samp(coalesce(value, median)) AS deviation FROM numbers JOIN medians USING (feature) GROUP BY feature", "numbers", "medians")
add("scaled", " UNION ALL ".join(f"SELECT ein, fiscal_year, {i} AS col, CASE WHEN deviation > 0 THEN (coalesce({x}, median) - mean) / deviation ELSE 0 END AS value FROM risk JOIN scales ON feature = '{n}' WHERE fiscal_year >= 1999" for i, (n, x) in enumerate(NUMBERS.items())), "risk", "scales")
add("cats", " UNION ALL ".join(f"SELECT '{c}' AS cat, {i} AS place, ein, fiscal_year, {c} AS v, fiscal_year <= 1998 AS seen FROM risk" for i, c in enumerate(features.CATEGORICAL)), "risk")
add("modes", "SELECT cat, v AS most FROM (SELECT cat, v, row_number() OVER (PARTITION BY cat ORDER BY count(*) DESC, v) AS r FROM cats WHERE seen AND v IS NOT NULL GROUP BY cat, v) WHERE r = 1", "cats")
add("cat_labels", "SELECT cat, place, v, row_number() OVER (PARTITION BY cat ORDER BY n DESC, v) - 1 AS i FROM (SELECT cat, place, coalesce(v, most) AS v, count(*) AS n FROM cats JOIN modes USING (cat) WHERE seen GROUP BY ALL)", "cats", "modes")
add("cat_columns", f"SELECT cat, w, {len(NUMBERS)} + sum(w) OVER (ORDER BY place) - w AS at0 FROM (SELECT cat, place, count(*) + 1 AS w FROM cat_labels GROUP BY ALL)", "cat_labels")


@query(
    "d11_preprocessing",
    """SELECT ein, fiscal_year, CAST(col AS INTEGER) AS place, round(value, 5) + 0.0 AS value FROM scaled
       UNION ALL SELECT ein, fiscal_year, CAST(at0 + j AS INTEGER), CASE WHEN j = coalesce(i, w - 1) THEN 1.0 ELSE 0.0 END FROM (
         SELECT c.ein, c.fiscal_year, o.at0, o.w, l.i, unnest(range(CAST(o.w AS BIGINT))) AS j FROM cats c JOIN modes m ON m.cat = c.cat JOIN cat_columns o ON o.cat = c.cat LEFT JOIN cat_labels l ON l.cat = c.cat AND l.v = coalesce(c.v, m.most) WHERE NOT c.seen AND c.fiscal_year >= 1999)""",
    "scaled", "cats", "modes", "cat_labels", "cat_columns",
)
def d11(spark, d):
    """The vectors that the models read, a row for each place."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    train, test = trained(spark, d)
    known = model.fills(train)
    fitted = Pipeline(stages=model.preprocessing()).fit(model.doubles(train).fillna(known))
    vectors = fitted.transform(model.doubles(test).fillna(known))
    long = vectors.select(*KEY, F.posexplode(vector_to_array("features")).alias("place", "value"))
    return long.withColumn("value", F.round("value", 5) + F.lit(0.0))


@query("d12_linear_model")
def d12(spark, d):
    train, test = trained(spark, d)
    return evaluate.areas(evaluate.by_score(model.score(test, model.fit_linear(train))))


@query("d13_boosted_trees")
def d13(spark, d):
    train, test = trained(spark, d)
    fitted = model.fit_trees(train)
    return evaluate.areas(evaluate.by_score(model.score(test, fitted))).withColumn("trees", F.lit(fitted.stages[-1].getNumTrees))


@query("d14_batch_scoring")
def d14(spark, d):
    whole = cut(frame(spark, d))  # the rows to score have no target yet
    train, _ = model.split(whole)
    keys = whole.where("fiscal_year IN (2000, 2001)")
    return model.score(keys, model.fit_linear(train)).select(*KEY, r6("proba"))


def test_rows(spark, d):
    known = stages.with_probability(features.concentration(features.target(measured(spark, d)))).where("target IS NOT NULL AND fiscal_year >= 1999")
    second = F.least(F.greatest(F.col("proba") * 0.5 + F.col("largest_source_pct") / 2, F.lit(0.01)), F.lit(0.99))
    return cut(known.withColumn("proba2", F.round(second, 6)))


_CURVE = "SELECT proba AS score, sum(sum(target)) OVER w AS tp, sum(sum(1 - target)) OVER w AS fp, sum(sum(target)) OVER () AS positives, sum(sum(1 - target)) OVER () AS negatives FROM test GROUP BY proba WINDOW w AS (ORDER BY proba DESC)"
add("curve", _CURVE, "test")


@query("d15_areas", "SELECT round(sum((fp - fp0) * (tp + tp0) / 2.0) / max(positives * negatives), 6) AS roc_auc, round(sum((tp - tp0) / positives * (tp / (tp + fp))), 6) AS pr_auc FROM (SELECT *, lag(tp, 1, 0) OVER (ORDER BY score DESC) AS tp0, lag(fp, 1, 0) OVER (ORDER BY score DESC) AS fp0 FROM curve)", "curve")
def d15(spark, d):
    return evaluate.areas(evaluate.by_score(test_rows(spark, d)))


@query("d15_curve", "SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve", "curve")
def d15b(spark, d):
    return evaluate.by_score(test_rows(spark, d)).select("score", "tp", "fp")


@query("d16_f1_threshold", "SELECT score AS threshold, round(2.0 * tp / (tp + fp + positives), 6) AS f1 FROM curve ORDER BY round(2.0 * tp / (tp + fp + positives), 9) DESC, score DESC LIMIT 1", "curve")
def d16(spark, d):
    return evaluate.best_threshold(evaluate.by_score(test_rows(spark, d)))


@query("d17_confusion", "SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(*) FILTER (proba >= 0.6 AND target = 1) AS tp, count(*) FILTER (proba >= 0.6 AND target = 0) AS fp, count(*) FILTER (proba < 0.6 AND target = 1) AS fn, count(*) FILTER (proba < 0.6 AND target = 0) AS tn FROM test)", "test")
def d17(spark, d):
    return evaluate.confusion(test_rows(spark, d), 0.6)


add("tiered", "SELECT t.*, CASE WHEN proba >= hi THEN 'High' WHEN proba >= CASE WHEN me >= hi THEN hi / 2 ELSE me END THEN 'Medium' ELSE 'Low' END AS distress_tier FROM test t, (SELECT greatest(0.6, quantile_cont(proba, 0.8)) AS hi, greatest(0.1, quantile_cont(proba, 0.5)) AS me FROM test)", "test")


@query("d18_tiers", "SELECT ein, fiscal_year, distress_tier FROM tiered", "tiered")
def d18(spark, d):
    return evaluate.tiers(test_rows(spark, d), 0.6).select(*KEY, "distress_tier")


@query("d19_tier_lift", "SELECT distress_tier, count(*) AS n, round(avg(target), 6) AS rate, round(avg(target) / (SELECT avg(target) FROM tiered), 6) AS lift FROM tiered GROUP BY 1", "tiered")
def d19(spark, d):
    return evaluate.lift(evaluate.tiers(test_rows(spark, d), 0.6))


@query("d19_yearly_lift", "SELECT fiscal_year, round(h, 6) AS high_rate, round(l, 6) AS low_rate, round(h / l, 6) AS lift FROM (SELECT fiscal_year, avg(target) FILTER (distress_tier = 'High') AS h, avg(target) FILTER (distress_tier = 'Low') AS l FROM tiered GROUP BY 1) WHERE l > 0 AND h IS NOT NULL", "tiered")
def d19b(spark, d):
    return evaluate.yearly_lift(evaluate.tiers(test_rows(spark, d), 0.6))


@query("d20_calibration", 'SELECT decile, coalesce(n, 0) AS "count", round(p, 6) AS mean_predicted, round(a, 6) AS actual_rate FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS decile) LEFT JOIN (SELECT CAST(least(floor(proba * 10), 9) AS INTEGER) AS decile, count(*) AS n, avg(proba) AS p, avg(target) AS a FROM test GROUP BY 1) USING (decile)', "test")
def d20(spark, d):
    return evaluate.calibration(test_rows(spark, d))


@query("d20_calibration_mae", "SELECT round(avg(abs(round(p, 6) - round(a, 6))), 5) AS mae FROM (SELECT least(floor(proba * 10), 9) AS decile, avg(proba) AS p, avg(target) AS a FROM test GROUP BY 1)", "test")
def d20b(spark, d):
    return evaluate.calibration_error(evaluate.calibration(test_rows(spark, d)))


@query(
    "d20_equal_frequency",
    """SELECT CAST(least(floor((t - 1) * 10 / (SELECT count(*) FROM test)), 9) AS INTEGER) AS bin, round(min(proba), 6) AS range_low, round(max(proba), 6) AS range_high, CAST(sum(n) AS BIGINT) AS "count", round(sum(proba * n) / sum(n), 6) AS mean_predicted, round(sum(a) / sum(n), 6) AS actual_rate
       FROM (SELECT proba, n, a, CAST(sum(n) OVER (ORDER BY proba) AS BIGINT) AS t FROM (SELECT proba, count(*) AS n, sum(target) AS a FROM test GROUP BY proba)) GROUP BY 1""",
    "test",
)
def d20c(spark, d):
    return evaluate.calibration_by_rank(test_rows(spark, d))


@query("d21_coefficients")
def d21(spark, d):
    train, _ = trained(spark, d)
    return model.coefficients(spark, model.fit_linear(train))


@query("d21_importances")
def d21b(spark, d):
    train, _ = trained(spark, d)
    return model.importances(spark, model.fit_trees(train))


@query("d22_agreement", "SELECT count(*) FILTER (proba >= 0.5 AND proba2 >= 0.5) AS both, count(*) FILTER (proba >= 0.5 AND proba2 < 0.5) AS only_first, count(*) FILTER (proba < 0.5 AND proba2 >= 0.5) AS only_second, count(*) FILTER (proba < 0.5 AND proba2 < 0.5) AS neither, round(corr(proba, proba2), 6) AS correlation FROM test", "test")
def d22(spark, d):
    return evaluate.agreement(test_rows(spark, d), "proba", "proba2", 0.5)


@query("d23_drivers")
def d23(spark, d):
    train, test = trained(spark, d)
    fitted = model.fit_linear(train)
    return model.drivers(model.score(test, fitted), fitted)


@query("d23_global_drivers")
def d23b(spark, d):
    train, test = trained(spark, d)
    fitted = model.fit_linear(train)
    return model.global_drivers(model.score(test, fitted), fitted).select("feature", r6("mean_abs_contribution"))
