"""Portfolio export and composite score (X), de-identification (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import metrics as m
from ledgerline.operators import analogs, cards, deid, merge, portfolio, profile, score, stress
from ledgerline.plans import stages
from ledgerline.plans import testpanel as tp
from ledgerline.plans.oracle import add
from ledgerline.plans.reuse import cut, scratch
from ledgerline.queries import replaying  # noqa: F401  defines the views it shares
from ledgerline.queries.base import COMPLETE_SQL, YIELD_SQL, completeness, investment_yield
from ledgerline.registry import query

c = F.col
r6 = lambda n: F.round(n, 6).alias(n)

add("streaks", "SELECT ein, max(fiscal_year) AS fiscal_year, count(*) FILTER (broken = 0) AS streak FROM (SELECT *, sum(CAST(NOT good AS INT)) OVER (PARTITION BY ein ORDER BY fiscal_year DESC) AS broken FROM (SELECT ein, fiscal_year, coalesce(investment_income > 0, false) AND fiscal_year + row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) - 1 = max(fiscal_year) OVER (PARTITION BY ein) AS good FROM panel)) GROUP BY ein", "panel")
_BAND = lambda x: f"CASE WHEN {x} < 1 THEN 'Severe' WHEN {x} < 3 THEN 'Moderate' WHEN {x} < 6 THEN 'Mild' ELSE 'None' END"
add(
    "orgs",
    f"""SELECT *, CASE WHEN tier = 'Low' THEN 'Needs Data Diligence' WHEN margin_pct >= 0 AND rdi >= 0.5 THEN 'Underinvested Asset Base' WHEN rdi < 0.5 THEN 'Revenue Concentration Risk' ELSE 'Weak Financial Foundation' END AS action_label,
      CASE WHEN risk_pct >= 60 THEN 'High' WHEN risk_pct >= 40 THEN 'Medium' ELSE 'Low' END AS risk_tier, CASE WHEN runway_months < 3 AND margin_pct < 0 THEN 'flagged' ELSE 'none' END AS urgency_severity FROM (
      SELECT d.*, operating_margin * 100 AS margin_pct, revenue_diversification_index AS rdi, revenue_diversification_index - 0.5 AS diversification_gap, operating_margin - 0.05 AS margin_gap, operating_runway_proxy_months - 6 AS runway_gap, shock_absorption_months AS runway_months,
        {YIELD_SQL} AS investment_yield, {COMPLETE_SQL} AS completeness, {_BAND('burn25')} AS severity25, CASE WHEN cash_non_interest_bearing IS NULL THEN 'Low' WHEN revenue_diversification_index > 0.6 THEN 'High' ELSE 'Medium' END AS tier,
        round(least(greatest(0.5 - 2 * coalesce(operating_margin, 0) + (6 - least(coalesce(shock_absorption_months, 0), 12)) / 20, 0.01), 0.99), 6) * 100 AS risk_pct, 1 AS recovery_analog_count,
        CASE WHEN operating_margin < 0 THEN 'low_margin' WHEN shock_absorption_months < 6 THEN 'low_runway' WHEN revenue_diversification_index < 0.6 THEN 'high_concentration' END AS "constraint", s.streak, row_number() OVER (PARTITION BY d.ein ORDER BY d.fiscal_year DESC) AS rn
      FROM deficits d JOIN streaks s ON d.ein = s.ein) WHERE rn = 1""",
    "deficits", "streaks",
)


_N = lambda x, k=1: f"format('{{:.{k}f}}', round({x}, {k}))"
_CUR = lambda x: f"CASE WHEN abs({x}) >= 1e9 THEN '$' || {_N(f'{x} / 1e9')} || 'B' WHEN abs({x}) >= 1e6 THEN '$' || {_N(f'{x} / 1e6')} || 'M' WHEN abs({x}) >= 1e3 THEN '$' || {_N(f'{x} / 1e3', 0)} || 'K' ELSE '$' || {_N(x, 0)} END"
_SIGNED = lambda x: f"CASE WHEN coalesce({x}, 0) < 0 THEN '' ELSE '+' END || {_N(f'coalesce({x}, 0)', 2)}"
_BY = lambda optimise, diversify, review, other: f"CASE action_label WHEN 'Underinvested Asset Base' THEN {optimise} WHEN 'Revenue Concentration Risk' THEN {diversify} WHEN 'Needs Data Diligence' THEN {review} ELSE {other} END"
_OF = lambda runway, margin, mix: f"CASE \"constraint\" WHEN 'low_runway' THEN '{runway}' WHEN 'low_margin' THEN '{margin}' ELSE '{mix}' END"
_RISK = "CASE WHEN risk_pct >= 70 THEN 'High' WHEN risk_pct >= 40 THEN 'Elevated' WHEN risk_pct >= 20 THEN 'Moderate' ELSE 'Lower' END"
_REASON = _BY("'ahead of its peers'", "'sound, few sources'", "'data in doubt'", _OF("short runway", "weak margin", "few sources"))
_KIND = _BY("'growth capital'", "'grant for a wider mix'", "'desk review'", _OF("bridge loan", "turnaround plan", "grant for a wider mix"))
_STATUS = _BY("'go'", "'go with mix targets'", "'hold'", "'go with margin targets'")
_MOVE = _BY("'start'", "'start small'", "'check the filings'", "'agree on targets'")
_WORTH = "CASE action_label WHEN 'Needs Data Diligence' THEN 30 WHEN 'Weak Financial Foundation' THEN 36 WHEN 'Revenue Concentration Risk' THEN 30 WHEN 'Underinvested Asset Base' THEN 24 ELSE 0 END"
add("kinds", f"""SELECT *, least(q0, n) AS q, sum(greatest(q0 - n, 0)) OVER (PARTITION BY action_label) AS over FROM (
  SELECT *, CAST(rank <= places AS INT) + whole + CAST(row_number() OVER (PARTITION BY action_label ORDER BY rest DESC, n DESC, kind) <= left_ - sum(whole) OVER (PARTITION BY action_label) AS INT) AS q0 FROM (
    SELECT *, CAST(floor(n / total * left_) AS INT) AS whole, round(n / total * left_ - floor(n / total * left_), 9) AS rest FROM (
      SELECT *, row_number() OVER (PARTITION BY action_label ORDER BY n DESC, kind) AS rank, sum(n) OVER (PARTITION BY action_label) AS total, greatest(places - count(*) OVER (PARTITION BY action_label), 0) AS left_ FROM (
        SELECT action_label, "constraint" AS kind, count(*) AS n, max({_WORTH}) AS places FROM orgs WHERE "constraint" IS NOT NULL GROUP BY ALL))))""", "orgs")
add("more_places", "SELECT action_label, kind, count(*) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY action_label ORDER BY k, rank) AS t FROM (SELECT action_label, kind, over, rank, unnest(range(1, CAST(least(n - q, over) AS BIGINT) + 1)) AS k FROM kinds WHERE q < n AND over > 0)) WHERE t <= over GROUP BY ALL", "kinds")
add("quotas", 'SELECT action_label, kind AS "constraint", CAST(q + coalesce(extra, 0) AS BIGINT) AS quota FROM kinds LEFT JOIN more_places USING (action_label, kind)', "kinds", "more_places")


def orgs(spark, d):
    """The latest filing of each organisation with what the score reads; label and tier by simple rules."""
    p = cut(stages.with_probability(m.with_metrics(stress.deficit_stress(tp.panel(spark, d)))))
    streak = portfolio.income_streak(p).select("ein", "streak")
    df = merge.latest_row(p).join(streak, "ein").withColumns(
        {
            "margin_pct": c("operating_margin") * 100, "rdi": c("revenue_diversification_index"), "diversification_gap": c("revenue_diversification_index") - 0.5, "margin_gap": c("operating_margin") - 0.05,
            "runway_gap": c("operating_runway_proxy_months") - 6, "runway_months": c("shock_absorption_months"), "investment_yield": investment_yield(), "completeness": completeness(), "risk_pct": c("proba") * 100,
            "tier": F.when(c("cash_non_interest_bearing").isNull(), "Low").when(c("revenue_diversification_index") > 0.6, "High").otherwise("Medium"), "recovery_analog_count": F.lit(1), "trend_direction": F.lit("unavailable"),
            "constraint": F.when(c("operating_margin") < 0, "low_margin").when(c("shock_absorption_months") < 6, "low_runway").when(c("revenue_diversification_index") < 0.6, "high_concentration"),
        }
    )
    label = F.when(c("tier") == "Low", "Needs Data Diligence").when((c("margin_pct") >= 0) & (c("rdi") >= 0.5), "Underinvested Asset Base").when(c("rdi") < 0.5, "Revenue Concentration Risk").otherwise("Weak Financial Foundation")
    risk = F.when(c("risk_pct") >= 60, "High").when(c("risk_pct") >= 40, "Medium").otherwise("Low")
    return cut(df.withColumns({"action_label": label, "risk_tier": risk, "urgency_severity": F.when((c("runway_months") < 3) & (c("margin_pct") < 0), "flagged").otherwise("none"), "largest_pct": c("largest_pct")}))


def panel(spark, d):
    return m.with_metrics(tp.panel(spark, d))


@query("x01_filing_history", "SELECT ein, count(DISTINCT fiscal_year) AS filing_years_observed, min(fiscal_year) AS first_filing_year, max(fiscal_year) AS latest_filing_year FROM panel GROUP BY ein", "panel")
def x01(spark, d):
    return portfolio.history(tp.panel(spark, d))


@query("x02_income_streak", "SELECT ein, fiscal_year, streak FROM streaks", "streaks")
def x02(spark, d):
    return portfolio.income_streak(tp.panel(spark, d))


@query("x03_financial_history", "SELECT ein, fiscal_year, total_revenue AS revenue, round((coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0)) - 0, 1) AS liquid FROM panel", "panel")
def x03(spark, d):
    t = portfolio.financial_history(panel(spark, d).withColumns({}))
    rows = t.select("ein", F.inline("history"))
    return rows.select("ein", c("fiscalYear").alias("fiscal_year"), "revenue", "liquidReserves").join(tp.panel(spark, d).select("ein", "fiscal_year", c("total_revenue").alias("exact"), F.round(m.liquid(), 1).alias("liquid")), ["ein", "fiscal_year"]).select("ein", "fiscal_year", c("exact").alias("revenue"), "liquid")


@query("x04_composition_history", "SELECT ein, fiscal_year, round(coalesce(pct_contributions, 0) * 100, 4) AS a, round(coalesce(pct_other_revenue, 0) * 100, 4) AS d FROM panel", "panel")
def x04(spark, d):
    rows = portfolio.composition_history(tp.panel(spark, d)).select("ein", F.inline("composition"))
    return rows.select("ein", c("fiscalYear").alias("fiscal_year"), c("contributionsPct").alias("a"), c("otherPct").alias("d"))


add("quartiles", "SELECT state, ntee_major_category, fiscal_year, round(quantile_cont(operating_margin, 0.25), 6) AS q25, round(quantile_cont(operating_margin, 0.5), 6) AS q50, round(quantile_cont(operating_margin, 0.75), 6) AS q75 FROM metrics WHERE ntee_major_category IS NOT NULL AND operating_margin IS NOT NULL GROUP BY ALL", "metrics")


def quartiles(spark, d):
    return quartiles_of(cut(panel(spark, d).select("ein", "fiscal_year", "state", "ntee_major_category", "operating_margin")))


def quartiles_of(p):
    return portfolio.peer_quartiles(p, p.select("state", "ntee_major_category").distinct())


@query("x05_peer_quartiles", "SELECT * FROM quartiles", "quartiles")
def x05(spark, d):
    return quartiles(spark, d)


_PCT = lambda q: f"format('{{:.1f}}', round({q} * 100, 1) + 0.0)"


@query("x05_peer_series", f"SELECT state, ntee_major_category, string_agg(fiscal_year || ': ' || {_PCT('q25')} || ' ' || {_PCT('q50')} || ' ' || {_PCT('q75')}, '; ' ORDER BY fiscal_year) AS series FROM quartiles GROUP BY ALL", "quartiles")
def x05b(spark, d):
    """The nested series, shown as one text for each state and sector."""
    n = lambda x, f: F.format_string("%.1f", F.round(x[f], 1))
    text = lambda x: F.concat(x["fiscalYear"].cast("string"), F.lit(": "), n(x, "peerMarginQ25"), F.lit(" "), n(x, "peerMarginMedian"), F.lit(" "), n(x, "peerMarginQ75"))
    return portfolio.peer_series(quartiles(spark, d)).select("state", "ntee_major_category", F.array_join(F.transform("series", text), "; ").alias("series"))


_POINTS = "CASE action_label WHEN 'Needs Data Diligence' THEN 4 WHEN 'Weak Financial Foundation' THEN 3 WHEN 'Revenue Concentration Risk' THEN 2 ELSE 1 END * 100 + CASE risk_tier WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END * 20 + CASE urgency_severity WHEN 'flagged' THEN 2 ELSE 1 END * 10 + 1 + abs(coalesce(margin_gap, 0)) + abs(coalesce(runway_gap, 0)) / 10 + abs(coalesce(diversification_gap, 0))"


@query("x06_priority", f"SELECT ein, round({_POINTS}, 6) AS priority FROM orgs", "orgs")
def x06(spark, d):
    return orgs(spark, d).select("ein", F.round(portfolio.priority(), 6).alias("priority"))


@query("x07_quotas", 'SELECT * FROM quotas', "quotas")
def x07(spark, d):
    return portfolio.quotas(orgs(spark, d), portfolio.PLACES)


_BEST = "priority DESC, risk_pct DESC, total_revenue DESC, ein"


@query(
    "x08_shortlist",
    f"""SELECT ein, action_label, "constraint", priority, CAST(row_number() OVER (ORDER BY priority DESC, risk_pct DESC, org_name, ein) AS INTEGER) AS place FROM (SELECT *, {_WORTH} - sum(CAST(inside AS INT)) OVER (PARTITION BY action_label) AS open, row_number() OVER (PARTITION BY action_label, inside ORDER BY {_BEST}) AS fill FROM (
        SELECT r.*, coalesce(k <= quota, false) AS inside FROM (SELECT *, row_number() OVER (PARTITION BY action_label, "constraint" ORDER BY {_BEST}) AS k FROM (SELECT *, round({_POINTS}, 6) AS priority FROM orgs)) r
        LEFT JOIN quotas q ON q.action_label = r.action_label AND q."constraint" = r."constraint")) WHERE inside OR fill <= open""",
    "orgs", "quotas",
)
def x08(spark, d):
    return portfolio.shortlist(orgs(spark, d).withColumn("priority", F.round(portfolio.priority(), 6)), portfolio.PLACES).select("ein", "action_label", "constraint", "priority", "place")


@query("x09_score_drivers", "SELECT ein, round(greatest(0, 100 - risk_pct), 1) AS protection, CASE WHEN margin_pct >= 12 THEN 92.0 WHEN margin_pct >= 6 THEN 80.0 WHEN margin_pct >= 0 THEN 64.0 WHEN margin_pct >= -8 THEN 40.0 ELSE 18.0 END AS margin, CASE WHEN rdi >= 0.5 THEN 90.0 WHEN rdi >= 0.35 THEN 74.0 WHEN rdi >= 0.2 THEN 58.0 WHEN rdi >= 0.05 THEN 38.0 ELSE 20.0 END AS mix, CASE tier WHEN 'High' THEN 95.0 WHEN 'Low' THEN 52.0 ELSE 75.0 END AS evidence FROM orgs", "orgs")
def x09(spark, d):
    return orgs(spark, d).select("ein", score.protection().alias("protection"), score.margin_score().alias("margin"), score.mix_score().alias("mix"), score.evidence().alias("evidence"))


@query(
    "x12_organisation_record",
    """SELECT 'org-' || o.ein AS id, org_name, state, ntee_major_category AS sector, fiscal_year, action_label, round(risk_pct, 6) AS probability, risk_tier, round(runway_gap, 6) AS runway_gap, severity25, round(burn50, 6) AS burn50,
         total_revenue AS revenue, round(investment_yield, 6) AS yield, tier AS confidence, completeness AS fields, streak AS years_investing, h.years, h.first_year, h.last_mix
       FROM orgs o JOIN (SELECT ein, count(*) AS years, min(fiscal_year) AS first_year, round(max_by(coalesce(pct_contributions, 0), fiscal_year) * 100, 4) AS last_mix FROM panel GROUP BY ein) h ON h.ein = o.ein""",
    "orgs", "panel",
)
def x12(spark, d):
    r = portfolio.record(orgs(spark, d), panel(spark, d))
    return r.select(
        "id", c("orgName").alias("org_name"), "state", "sector", c("fiscalYear").alias("fiscal_year"), c("actionLabel").alias("action_label"), F.round("distress.probability", 6).alias("probability"), c("distress.tier").alias("risk_tier"),
        F.round("benchmark.runway_gap", 6).alias("runway_gap"), "stress.severity25", F.round("stress.burn50", 6).alias("burn50"), c("financials.total_revenue").alias("revenue"), F.round("financials.investment_yield", 6).alias("yield"),
        "evidence.confidence", "evidence.fields", c("evidence.yearsInvesting").alias("years_investing"), F.size("history").cast("long").alias("years"), c("history")[0]["fiscalYear"].alias("first_year"), F.element_at("composition", -1)["contributionsPct"].alias("last_mix"),
    )


@query("x14_header", "SELECT count(*) AS total, string_agg(DISTINCT state, ',' ORDER BY state) AS states, round(avg(risk_pct / 100), 6) AS baseline_rate FROM orgs", "orgs")
def x14b(spark, d):
    return portfolio.header(orgs(spark, d), c("risk_pct") / 100)


@query("x14_summary", "SELECT 'label' AS kind, action_label AS value, count(*) AS n FROM orgs GROUP BY 2 UNION ALL SELECT 'risk_tier', risk_tier, count(*) FROM orgs GROUP BY 2 UNION ALL SELECT 'confidence', tier, count(*) FROM orgs GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM orgs", "orgs")
def x14(spark, d):
    return portfolio.summary(orgs(spark, d))


_A = "coalesce(net_assets_eoy, 0)"
_SCALE = lambda k: f"CASE WHEN {_A} > 0 THEN least(ln(least(greatest({_A}, 1), 5e7)) / ln(5e7), 1.0) * {k} ELSE 0 END"
_GAP = "greatest(5 - least(greatest(investment_yield, 0), 100), 0) / 5 * 15.0"
_EV = "CASE tier WHEN 'High' THEN 95.0 WHEN 'Low' THEN 52.0 ELSE 75.0 END"
_BASE = "(1 - least(greatest(rdi, 0), 1)) * 100"
_NEED = f"({_BASE} * 0.45 + CASE WHEN largest_pct > 0 THEN least(greatest(largest_pct, 0), 100) ELSE {_BASE} END * 0.3 + least(greatest(greatest(-diversification_gap, 0) / 0.5 * 100, 0), 100) * 0.25)"
_SEV = "CASE lower(severity25) WHEN 'severe' THEN 95.0 WHEN 'moderate' THEN 74.0 WHEN 'mild' THEN 48.0 WHEN 'none' THEN 16.0 ELSE 36.0 END"
_VUL = f"({_SEV} * 0.4 + least(greatest((24 - least(burn25, 24)) / 24 * 100, 0), 100) * 0.6)"
_SUP = "least(greatest((margin_pct + 20) / 40 * 100, 0), 100)"
_STRUCT = f"CASE action_label WHEN 'Revenue Concentration Risk' THEN {_NEED} * 0.45 + {_SUP} * 0.25 + {_VUL} * 0.1 + {_EV} * 0.2 ELSE (100 - {_EV}) * 0.6 + {_VUL} * 0.25 + {_NEED} * 0.15 END / 100 * 40"
_FOUND = f"CASE WHEN {_A} BETWEEN 1e6 AND 2e7 THEN 15.0 WHEN {_A} >= 5e5 AND {_A} < 1e6 THEN 8.0 WHEN {_A} > 2e7 AND {_A} <= 5e7 THEN 10.0 WHEN {_A} > 5e7 AND {_A} <= 1e8 THEN 5.0 ELSE 0.0 END + CASE WHEN margin_pct BETWEEN -10 AND 5 THEN 10.0 WHEN margin_pct >= -20 AND margin_pct < -10 THEN 6.0 WHEN margin_pct > 5 AND margin_pct <= 15 THEN 5.0 ELSE 0.0 END + CASE WHEN runway_months < 3 THEN 10.0 WHEN runway_months < 6 THEN 7.0 WHEN runway_months < 12 THEN 3.0 ELSE 0.0 END + {_EV} / 100 * 5"
_SOPH = f"{_SCALE('15.0')} + CASE WHEN streak >= 5 THEN 10.0 WHEN streak >= 3 THEN 7.0 WHEN streak >= 1 THEN 3.0 ELSE 0.0 END + {_GAP}"
_FIT = f"CASE WHEN action_label = 'Underinvested Asset Base' AND {_A} > 1e6 AND investment_yield < 3 THEN 10.0 WHEN action_label = 'Revenue Concentration Risk' AND {_A} > 1e6 THEN 8.0 WHEN action_label = 'Weak Financial Foundation' AND {_A} BETWEEN 1e6 AND 2e7 THEN 10.0 WHEN action_label = 'Weak Financial Foundation' AND {_A} > 2e7 AND {_A} <= 5e7 THEN 5.0 ELSE 0.0 END"
add(
    "fit",
    f"""SELECT *, CAST(floor(round(CASE WHEN {_A} > 5e8 THEN least(raw, 30) WHEN {_A} < 5e5 AND action_label <> 'Revenue Concentration Risk' THEN least(raw, 40) ELSE raw END, 9) + 0.5) AS INTEGER) AS fit_score FROM (
      SELECT *, least(greatest(opportunity + middle + confidence + fit_bonus + distress, 0), 100) AS raw FROM (SELECT *, {_SCALE('25.0')} + {_GAP} AS opportunity, CASE action_label WHEN 'Underinvested Asset Base' THEN {_SOPH} WHEN 'Weak Financial Foundation' THEN {_FOUND} ELSE {_STRUCT} END AS middle,
        {_EV} / 100 * 12 + least(greatest(completeness, 0), 8) AS confidence, {_FIT} AS fit_bonus, CASE WHEN risk_pct > 70 THEN -15.0 WHEN risk_pct > 50 THEN -8.0 WHEN risk_pct > 35 THEN -3.0 ELSE 0.0 END AS distress FROM orgs))""",
    "orgs",
)


def fit(spark, d):
    return score.scored(orgs(spark, d))


@query("x15_opportunity", "SELECT ein, round(opportunity, 6) AS opportunity FROM fit", "fit")
def x15(spark, d):
    return fit(spark, d).select("ein", r6("opportunity"))


@query("x16_structural", f"SELECT ein, round({_STRUCT}, 6) AS structural FROM orgs", "orgs")
def x16(spark, d):
    return orgs(spark, d).select("ein", F.round(score.structural(), 6).alias("structural"))


@query("x17_foundation_and_assets", f"SELECT ein, round({_FOUND}, 6) AS foundation, round({_SOPH}, 6) AS sophistication FROM orgs", "orgs")
def x17(spark, d):
    df = orgs(spark, d).withColumn("net_assets_eoy", F.coalesce("net_assets_eoy", F.lit(0.0)))
    return df.select("ein", F.round(score.foundation(), 6).alias("foundation"), F.round(score.sophistication(), 6).alias("sophistication"))


@query("x18_fit_score", "SELECT ein, fit_score FROM fit", "fit")
def x18(spark, d):
    return fit(spark, d).select("ein", "fit_score")


@query("x19_score_breakdown", "SELECT ein, unnest(['opportunity', 'middle', 'confidence', 'fit_bonus', 'distress']) AS component, round(unnest([opportunity, middle, confidence, fit_bonus, distress]), 6) AS value, unnest([40.0, 40.0, 20.0, 10.0, 0.0])::DOUBLE AS most FROM fit", "fit")
def x19(spark, d):
    return score.breakdown(fit(spark, d))


@query("x20_stability_index", "SELECT ein, CAST(floor(round(least(greatest(50 + margin_gap * 120, 0), 100) * 0.4 + least(greatest(50 + runway_gap * 2.2, 0), 100) * 0.35 + least(greatest(50 + diversification_gap * 80, 0), 100) * 0.25, 9) + 0.5) AS INTEGER) AS stability FROM orgs", "orgs")
def x20(spark, d):
    return orgs(spark, d).select("ein", score.stability_index(c("margin_gap"), c("runway_gap"), c("diversification_gap")).alias("stability"))


@query(
    "x21_advisory_note",
    f"""SELECT ein, action_label, {_BY(f"'Net assets ' || {_CUR('net_assets_eoy')} || ', yield ' || {_N('investment_yield')} || '%' || CASE WHEN streak >= 1 THEN ', ' || streak || ' years of investment income' ELSE '' END || '. First: what is liquid and unrestricted.'",
        f"'Main source ' || {_N('largest_pct', 0)} || '%; without a quarter of it ' || {_N('burn25')} || ' months remain. First: a second source.'",
        "'Balance sheet ' || CAST(floor(least(greatest(completeness / 8 * 5, 0), 5) + 0.5) AS BIGINT) || ' of 5 complete. First: the missing fields.'",
        f"'Margin ' || {_N('margin_pct')} || '%, reserves ' || {_N('runway_months')} || ' months. First: a reserve target.'")} AS note FROM orgs""",
    "orgs",
)
def x21(spark, d):
    return orgs(spark, d).select("ein", "action_label", score.note().alias("note"))


_PRESSURE = f"""[CASE WHEN margin_gap < -0.15 THEN 'margin ' || {_N('abs(margin_gap)', 2)} || ' under peers' END, CASE WHEN runway_gap < -6 THEN 'runway ' || {_N('abs(runway_gap)')} || ' months under peers' END,
  CASE WHEN diversification_gap < -0.08 THEN 'revenue mix ' || {_N('abs(diversification_gap)', 2)} || ' under peers' END,
  CASE WHEN largest_pct <= 0 THEN 'revenue split unknown' WHEN burn50 <= 6 THEN {_N('abs(burn50)')} || ' months left if half of the main source goes' END]"""
_SUPPORT = f"""['recovered peers: ' || recovery_analog_count, CASE WHEN runway_months < 12 THEN 'bridge to 12 months: ' || {_N('12 - runway_months')} || ' missing' END, CASE WHEN rdi < 0.5 THEN 'mix can widen from ' || {_N('rdi', 2)} END, CASE WHEN tier = 'High' THEN 'evidence is high' END]"""
_KEPT = lambda x, k: f"array_to_string(list_filter({x}, lambda x: x IS NOT NULL)[1:{k}], '; ')"


@query("x22_pressure_and_support", f"SELECT ein, coalesce(nullif({_KEPT(_PRESSURE, 4)}, ''), 'no finding') AS pressure, {_KEPT(_SUPPORT, 3)} AS support FROM orgs", "orgs")
def x22(spark, d):
    return orgs(spark, d).select("ein", F.array_join(score.pressure_points(), "; ").alias("pressure"), F.array_join(score.support_signals(), "; ").alias("support"))


@query("x23_status_tone", "SELECT ein, CASE WHEN fit_score >= 75 AND risk_pct < 25 THEN 'Strong' WHEN fit_score >= 45 AND risk_pct < 60 THEN 'Mixed' ELSE 'Fragile' END AS tone FROM fit", "fit")
def x23(spark, d):
    return fit(spark, d).select("ein", score.tone().alias("tone"))


_ROW = lambda name, own, gap: f"SELECT ein, '{name}' AS metric, round({own}, 6) AS own, round({own} - {gap}, 6) AS peers, CASE WHEN {gap} IS NULL THEN 'unknown' WHEN {gap} > 0 THEN 'ahead' WHEN {gap} < 0 THEN 'behind' ELSE 'level' END AS position FROM orgs"


@query("x23_peer_position", " UNION ALL ".join([_ROW("margin", "operating_margin", "margin_gap"), _ROW("runway", "operating_runway_proxy_months", "runway_gap"), _ROW("mix", "rdi", "diversification_gap")]), "orgs")
def x23b(spark, d):
    return score.peer_position(orgs(spark, d))


@query("x25_search", "SELECT ein, fit_score FROM fit WHERE contains(lower(org_name), '0001') OR contains(lower(state), '0001') OR contains(lower(action_label), '0001')", "fit")
def x25(spark, d):
    return portfolio.search(fit(spark, d), "0001").select("ein", "fit_score")


_SEARCH = lambda text, columns, by: f"SELECT ein, CAST(row_number() OVER (ORDER BY {by}) AS INTEGER) AS place FROM fit WHERE {' OR '.join(f"""contains(lower({x}), '{text}')""" for x in columns)}"


@query("x25_indexed_search", _SEARCH("000012", portfolio.SEARCHED, "fit_score DESC, org_name"), "fit")
def x25b(spark, d):
    """By the posting table of the four columns; places in the order of the score."""
    rows, path = cut(fit(spark, d)), scratch(spark)
    portfolio.index_texts(rows, path)
    found = portfolio.search(rows, "000012", postings=spark.read.parquet(path))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fit_score"), "org_name"))).select("ein", "place")


@query("x25_search_by_name", _SEARCH("concentration", portfolio.SEARCHED, "lower(org_name), org_name, ein"), "fit")
def x25c(spark, d):
    rows, path = cut(fit(spark, d)), scratch(spark)
    portfolio.index_texts(rows, path)
    found = portfolio.search(rows, "Concentration ", by="name", postings=spark.read.parquet(path))
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.lower("org_name"), "org_name", "ein"))).select("ein", "place")


@query("x26_lanes", "SELECT action_label, count(*) AS n FROM orgs GROUP BY 1", "orgs")
def x26(spark, d):
    return orgs(spark, d).groupBy("action_label").agg(F.count("*").alias("n"))


_OPTIONS = " UNION ALL ".join(f"SELECT '{f}' AS facet, {f} AS option, list_position({list(o)}::VARCHAR[], {f}) AS pos FROM orgs" for f, o in portfolio.FACETS.items())


@query("x26_facets", f"SELECT facet, option, n, CAST(row_number() OVER (PARTITION BY facet ORDER BY coalesce(pos, 99), option) AS INTEGER) AS place FROM (SELECT facet, option, nullif(any_value(pos), 0) AS pos, count(*) AS n FROM ({_OPTIONS}) WHERE option IS NOT NULL GROUP BY facet, option)", "orgs")
def x26b(spark, d):
    return portfolio.facets(orgs(spark, d))


add("margin_trends", "SELECT ein, CASE WHEN move > 0.01 THEN 'improving' WHEN move < -0.01 THEN 'declining' WHEN move IS NOT NULL THEN 'stable' END AS margin_trend FROM (SELECT ein, max(operating_margin) FILTER (k = 1) - max(operating_margin) FILTER (k = 2) AS move FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) AS k FROM metrics) GROUP BY ein)", "metrics")


@query("x27_priority_pipeline", "SELECT ein, margin_trend, round((0.5 - rdi) * total_revenue, 2) AS pipeline_score FROM orgs JOIN margin_trends USING (ein) WHERE action_label = 'Revenue Concentration Risk' AND total_revenue BETWEEN 250000 AND 1e8 AND rdi < 0.5 AND margin_trend IN ('stable', 'improving') ORDER BY pipeline_score DESC, ein LIMIT 60", "orgs", "margin_trends")
def x27(spark, d):
    rows = orgs(spark, d).join(portfolio.margin_trend(panel(spark, d)), "ein")
    return portfolio.pipeline(rows, "Revenue Concentration Risk").select("ein", "margin_trend", "pipeline_score")


@query("x30_margin_pattern", "SELECT ein, CASE WHEN spread > 120 THEN 'variable' WHEN move > 8 THEN 'improving' WHEN move < -8 THEN 'softer' ELSE 'steady' END AS pattern FROM (SELECT ein, (max(operating_margin) - min(operating_margin)) * 100 AS spread, (max_by(operating_margin, fiscal_year) - min_by(operating_margin, fiscal_year)) * 100 AS move FROM metrics GROUP BY ein)", "metrics")
def x30(spark, d):
    return portfolio.margin_pattern(panel(spark, d))


@query("x31_change_since_start", "SELECT ein, change_pct, CASE WHEN abs(change_pct) < 2 THEN 'roughly flat' WHEN change_pct > 0 THEN 'up' WHEN change_pct < 0 THEN 'down' END AS wording FROM (SELECT ein, round((max_by(total_revenue, fiscal_year) - min_by(total_revenue, fiscal_year)) / nullif(abs(min_by(total_revenue, fiscal_year)), 0) * 100, 6) AS change_pct FROM panel GROUP BY ein)", "panel")
def x31(spark, d):
    return portfolio.change_since_start(tp.panel(spark, d), "total_revenue")


@query("x32_band_alignment", "SELECT m.ein, m.fiscal_year, CASE WHEN round(operating_margin, 6) < q25 THEN 'below' WHEN round(operating_margin, 6) > q75 THEN 'above' ELSE 'inside' END AS band FROM metrics m JOIN quartiles USING (state, ntee_major_category, fiscal_year)", "metrics", "quartiles")
def x32(spark, d):
    p = cut(panel(spark, d).select("ein", "fiscal_year", "state", "ntee_major_category", "operating_margin"))  # read by the quartiles and by the rows that meet them
    return portfolio.band_alignment(p, quartiles_of(p))


@query(
    "x10_narrative",
    f"""SELECT ein, {_REASON} AS reason, {_KIND} AS intervention, {_STATUS} AS decision_status, {_MOVE} AS next_move, {_RISK} AS risk_level, 'confidence: ' || lower(tier) AS confidence_note,
       concat_ws('; ', 'label: ' || action_label, CASE WHEN risk_tier = 'High' THEN 'risk tier high' END, CASE WHEN urgency_severity <> 'none' THEN 'urgent' END, CASE WHEN recovery_analog_count > 0 THEN 'has recovered peers' END) AS why_surfaced FROM orgs""",
    "orgs",
)
def x10(spark, d):
    return cards.narrative(orgs(spark, d)).select("ein", "reason", "intervention", "decision_status", "next_move", "risk_level", "confidence_note", "why_surfaced")


@query(
    "x11_scenario_cards",
    f"""SELECT ein, 'source-falls' AS id, 'A quarter less from the main source: ' || {_N('burn25')} || ' months left' AS thesis, CASE WHEN risk_pct < 18 THEN 'holds' ELSE 'in doubt' END AS effect FROM orgs
       UNION ALL SELECT ein, 'reserves-filled', 'Runway to peers: ' || {_SIGNED('runway_gap')} || ' months', CASE WHEN runway_gap >= 0 THEN 'optional' ELSE 'decisive' END FROM orgs
       UNION ALL SELECT ein, 'mix-widened', 'Mix to peers: ' || {_SIGNED('diversification_gap')}, CASE WHEN diversification_gap >= 0 THEN 'done' ELSE 'lowers risk' END FROM orgs""",
    "orgs",
)
def x11(spark, d):
    return orgs(spark, d).select("ein", F.inline(cards.scenario_cards(18.0)))


@query("x11_analog_cards", "SELECT ein, fiscal_year, peer, peer_name || ' (' || peer_state || ')' AS title, 'FY' || pre_year || '-FY' || post_year AS span, metric, round(round(post_value, 6) - round(pre_value, 6), 6) AS gain FROM matched", "matched")
def x11b(spark, d):
    return stages.recovered(tp.panel(spark, d), tp.CONFIG).select("ein", "fiscal_year", F.inline(cards.analog_cards()))


@query("x13_label_patch", "SELECT ein, CASE WHEN ein IN ('1', '2') THEN 'Needs Data Diligence' ELSE action_label END AS action_label, round(investment_yield + 0.5, 3) AS investment_yield FROM orgs", "orgs")
def x13(spark, d):
    o = orgs(spark, d)
    over = spark.createDataFrame([("1", "Needs Data Diligence"), ("2", "Needs Data Diligence")], "ein string, action_label string")
    return cards.patched(o, over, o.select("ein", F.round("risk_pct", 1).alias("risk_pct"))).select("ein", "action_label", "investment_yield")


@query("x24_completeness_checklist", "SELECT ein, CAST(5 - len(gone) AS INTEGER) AS available, CASE WHEN len(gone) = 0 THEN 'None' ELSE array_to_string(gone, '; ') END AS missing FROM (SELECT o.ein, list_filter([CASE WHEN NOT coalesce(net_assets_eoy > 0, false) THEN 'Net assets' END, CASE WHEN NOT coalesce(total_revenue > 0, false) THEN 'Revenue' END, CASE WHEN NOT investment_yield > 0 THEN 'Investment yield' END, CASE WHEN n <= 1 THEN 'Multi-year history' END], lambda x: x IS NOT NULL) AS gone FROM orgs o JOIN (SELECT ein, count(DISTINCT fiscal_year) AS n FROM panel GROUP BY 1) h ON o.ein = h.ein)", "orgs", "panel")
def x24(spark, d):
    return cards.checklist(orgs(spark, d).join(portfolio.history(tp.panel(spark, d)).select("ein", "filing_years_observed"), "ein"))


@query("x28_card_tones", "SELECT ein, CASE WHEN margin_pct >= 5 THEN 'good' WHEN margin_pct >= 0 THEN 'fair' ELSE 'weak' END AS margin_tone, CASE WHEN runway_months >= 12 THEN 'good' WHEN runway_months >= 6 THEN 'fair' ELSE 'weak' END AS runway_tone, CASE WHEN f >= 2 THEN 'High' WHEN f = 1 THEN 'Moderate' ELSE 'Low' END AS gap_level FROM (SELECT *, CAST(margin_pct < 0 AS INT) + CAST(runway_months < 6 AS INT) + CAST(rdi < 0.35 AS INT) AS f FROM orgs)", "orgs")
def x28(spark, d):
    return cards.tones(orgs(spark, d))


_P = lambda n, v: f"{{'name': '{n}', 'value': {v}}}"
_ASSETS, _REVENUE, _RUNWAY = _P("Net assets", _CUR("net_assets_eoy")), _P("Total revenue", _CUR("total_revenue")), _P("Current cash runway", f"{_N('runway_months')} || ' months'")
_SHOWN = _BY(
    f"[{_ASSETS}, {_REVENUE}, {_P('Current investment yield', _N('investment_yield') + " || '%'")}, {_P('Years investing', 'CAST(streak AS VARCHAR)')}]",
    f"[{_ASSETS}, {_REVENUE}, {_P('Largest category', _N('largest_pct') + " || '%'")}, {_RUNWAY}, {_P('Runway after a 25% shock', _N('burn25') + " || ' months'")}]",
    f"[{_P('Data completeness', _N('completeness') + " || ' of 8'")}, {_P('Latest filing year', 'CAST(fiscal_year AS VARCHAR)')}]",
    f"[{_ASSETS}, {_REVENUE}, {_RUNWAY}, {_P('Operating margin', _N('margin_pct') + " || '%'")}]",
)


@query("x29_snapshot_metrics", f"SELECT ein, m.name, m.value FROM (SELECT ein, unnest({_SHOWN}) AS m FROM orgs)", "orgs")
def x29(spark, d):
    return cards.snapshot(orgs(spark, d))


@query("x29_pitch", f"""SELECT ein, {_BY(f"{_CUR('net_assets_eoy')} || ' of net assets could earn more than ' || {_N('investment_yield')} || '%'", f"'From ' || {_N('largest_pct', 0)} || '% in one source to a wider mix'", f"{_N('completeness', 0)} || ' of 8 fields reported: the rest comes first'", f"'From ' || {_N('margin_pct')} || '% margin to a surplus'")} AS pitch FROM orgs""", "orgs")
def x29b(spark, d):
    return orgs(spark, d).select("ein", cards.pitch().alias("pitch"))


@query("x33_inbox_row", f"SELECT ein, org_name || ': ' || {_MOVE} AS headline, 'FY' || fiscal_year || '; ' || {_CUR('total_revenue')} || '; risk ' || lower({_RISK}) AS facts, 'confidence: ' || lower(tier) AS confidence_note FROM orgs", "orgs")
def x33(spark, d):
    return cards.inbox_row(orgs(spark, d))


@query("x33_case_row", f"SELECT ein, org_name || ' (' || state || ')' AS title, {_STATUS} AS status, coalesce(nullif(concat_ws('; ', CASE WHEN tier = 'Low' THEN 'data in doubt' END, CASE WHEN cash_non_interest_bearing IS NULL THEN 'cash not reported' END, CASE WHEN largest_pct >= 90 THEN 'one source only' END), ''), 'none') AS caveats FROM orgs", "orgs")
def x33b(spark, d):
    return cards.case_row(orgs(spark, d))


@query("x33_funding_row", f"SELECT ein, {_KIND} AS kind, {_CUR('(CASE WHEN runway_months < 6 THEN greatest(6 - runway_months, 0.0) * total_expenses / 12 ELSE total_revenue / 20 END)')} AS amount, {_REASON} || '; ' || {_MOVE} AS purpose FROM orgs", "orgs")
def x33c(spark, d):
    return cards.funding_row(orgs(spark, d))


# --- de-identification ----------------------------------------------------------------------------------------------


def _fnv(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"


add("alias_cases", f"""SELECT ein, case_index, upper(left(seg, 1)) || lower(substr(seg, 2)) || ' Case ' || CASE WHEN case_index < 9 THEN '0' ELSE '' END || CAST(case_index + 1 AS VARCHAR) AS alias
  FROM (SELECT ein, seg, row_number() OVER (ORDER BY {_fnv('ein')}, ein) - 1 AS case_index FROM (SELECT CAST(c_custkey AS VARCHAR) AS ein, c_mktsegment AS seg FROM customer))""")


def _money(x: str, channel: str) -> str:
    unit = f"({_fnv(f"CAST(case_index AS VARCHAR) || ':' || CAST(fiscal_year AS VARCHAR) || ':{channel}'")} % 2001 / 1000.0::DOUBLE - 1)"
    scale = f"[{', '.join(f'{s}::DOUBLE' for s in deid.SCALES)}][CAST(case_index % {len(deid.SCALES)} AS INTEGER) + 1]"
    return f"CAST(floor(round({x} * {scale} * (1 + {unit} * 0.04::DOUBLE), 6) + 0.5::DOUBLE) AS BIGINT)"


add("alias_money", f"""SELECT ein, {_money('total_revenue', 'revenue')} AS new_revenue, {_money('total_expenses', 'expenses')} AS new_expenses
  FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) = 1) JOIN alias_cases USING (ein)""", "panel", "alias_cases")


@query("a01_stable_hash", f"SELECT c_custkey, {_fnv('c_name')} AS h FROM customer")
def a01(spark, d):
    return tp.table(spark, d, "customer").select("c_custkey", deid.fnv1a(c("c_name")).alias("h"))


def cases(spark, d):
    rows = tp.table(spark, d, "customer").select(c("c_custkey").cast("string").alias("ein"), c("c_name").alias("org_name"), "c_mktsegment", "c_acctbal")
    return deid.aliases(rows, F.initcap("c_mktsegment"))


@query("a02_aliases", "SELECT ein, case_index, alias FROM alias_cases", "alias_cases")
def a02(spark, d):
    return cases(spark, d).select("ein", "case_index", "alias")


add("peer_names", "SELECT DISTINCT peer_name FROM pool", "pool")


@query("a02_peer_aliases", f"SELECT peer_name, i AS case_index, 'Matched Peer ' || CASE WHEN i < 9 THEN '0' ELSE '' END || CAST(i + 1 AS VARCHAR) AS alias FROM (SELECT peer_name, row_number() OVER (ORDER BY {_fnv('peer_name')}, peer_name) - 1 AS i FROM peer_names)", "peer_names")
def a02b(spark, d):
    return deid.peer_aliases(analogs.pool(m.with_metrics(tp.panel(spark, d))), "peer_name")


def secrets(spark, d):
    """Names and nine-digit ids of all organisations, and what replaces them."""
    who = cases(spark, d)
    names = who.select(F.lit("name").alias("kind"), c("org_name").alias("secret"), c("alias").alias("replacement"))
    return names.unionByName(who.select(F.lit("id").alias("kind"), F.lpad("ein", 9, "0").alias("secret"), F.lit("REDACTED-EIN").alias("replacement")))


@query(
    "a03_text_scrub",
    """SELECT a.ein, 'Report on ' || a.alias || ' (EIN REDACTED-EIN), also called ' || a.alias || '; ' || b.alias || ' is like it. Its largest reported revenue category faced a 25% reported-category shock for not available months.' AS text
       FROM alias_cases a JOIN alias_cases b ON CAST(b.ein AS INTEGER) = CAST(a.ein AS INTEGER) % 10 + 1""",
    "alias_cases",
)
def a03(spark, d):
    who = cases(spark, d)
    other = who.select(c("ein").alias("_other"), c("org_name").alias("_name"))
    met = who.join(other, c("_other").cast("int") == c("ein").cast("int") % 10 + 1)
    text = F.concat(F.lit("Report on "), "org_name", F.lit(" (EIN "), F.lpad("ein", 9, "0"), F.lit("), also called "), F.upper("org_name"), F.lit("; "), F.replace("_name", F.lit("#"), F.lit(" ")), F.lit(" is like it. Its Largest Revenue Source faced a 25% source shock for NaN months."))
    return deid.scrub(met.select("ein", text.alias("text")), "ein", "text", secrets(spark, d))


def jittered(spark, d):
    one = merge.latest_row(tp.panel(spark, d)).join(cases(spark, d).select("ein", "case_index"), "ein")
    return one.withColumns({"new_revenue": deid.money(c("total_revenue"), c("case_index"), c("fiscal_year"), "revenue"), "new_expenses": deid.money(c("total_expenses"), c("case_index"), c("fiscal_year"), "expenses")})


_SIZE = "CASE WHEN new_revenue >= 10000000 THEN '>10M' WHEN new_revenue >= 2000000 THEN '2M-10M' WHEN new_revenue >= 500000 THEN '500K-2M' WHEN new_revenue IS NOT NULL THEN '<500K' END"


@query("a04_money_jitter", f"SELECT ein, new_revenue, new_expenses, round((new_revenue - new_expenses) / CAST(nullif(new_revenue, 0) AS DOUBLE) * 100, 1) AS margin, {_SIZE} AS size_bucket FROM alias_money", "alias_money")
def a04(spark, d):
    return jittered(spark, d).select("ein", "new_revenue", "new_expenses", F.round(F.try_divide(c("new_revenue") - c("new_expenses"), c("new_revenue")) * 100, 1).alias("margin"), deid.bucket(c("new_revenue")).alias("size_bucket"))


def perturbed(spark, d):
    z = lambda n: F.coalesce(n, F.lit(0.0)) * 100
    one = merge.latest_row(tp.panel(spark, d)).join(cases(spark, d).select("ein", "case_index"), "ein")
    parts = deid.composition([z("pct_contributions"), z("pct_program_revenue"), z("pct_investment_income"), z("pct_other_revenue")], c("case_index"), c("fiscal_year"))
    return one.select("ein", *[p.alias(n) for p, n in zip(parts, ("a", "b", "c", "d"))])


def _mixed() -> str:
    key = lambda ch: _fnv(f"CAST(case_index AS VARCHAR) || ':' || CAST(fiscal_year AS VARCHAR) || ':{ch}'")
    z = lambda n: f"coalesce({n}, 0) * 100"
    raw = f"""SELECT ein, greatest({z('pct_contributions')} + mix, 0) AS w, greatest({z('pct_program_revenue')} - mix * 0.65::DOUBLE, 0) AS x, greatest({z('pct_investment_income')} + inv, 0) AS y, greatest({z('pct_other_revenue')} - mix * 0.35::DOUBLE - inv, 0) AS v
      FROM (SELECT *, ({key('mix')} % 61 - 30) / 10.0::DOUBLE AS mix, ({key('investment')} % 17 - 8) / 10.0::DOUBLE AS inv FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) = 1) JOIN alias_cases USING (ein))"""
    tenth = lambda n: f"floor(round(coalesce({n} / nullif(w + x + y + v, 0), 0) * 1000, 6)) / 10"
    return f"SELECT ein, a, b, c, round(100 - a - b - c, 1) AS d FROM (SELECT ein, {tenth('w')} AS a, {tenth('x')} AS b, {tenth('y')} AS c FROM ({raw}))"


@query("a05_composition", _mixed(), "panel", "alias_cases")
def a05(spark, d):
    return perturbed(spark, d).select("ein", "a", "b", "c", "d")


add(
    "published",
    """SELECT ein, lower('Case ' || case_index || ': revenue $' || new_revenue || CASE WHEN CAST(ein AS INTEGER) % 50 = 0 THEN ', like CUSTOMER ' || lpad(CAST(CAST(ein AS INTEGER) - 1 AS VARCHAR), 9, '0') ELSE '' END
         || CASE WHEN CAST(ein AS INTEGER) % 70 = 0 THEN ' (EIN ' || lpad(ein, 9, '0') || ')' ELSE '' END || CASE WHEN CAST(ein AS INTEGER) % 90 = 0 THEN ', exactly ' || CAST(round(total_revenue) AS BIGINT) ELSE '' END) AS text
       FROM (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) = 1) JOIN alias_cases USING (ein) JOIN alias_money USING (ein)""",
    "panel", "alias_cases", "alias_money",
)
add("shown_words", "SELECT ein, text, unnest(regexp_extract_all(text, '[a-z0-9]+')) AS word FROM published", "published")
_AUDIT = """SELECT 'name' AS kind, count(DISTINCT c_name) AS secrets, count(DISTINCT ein) AS texts FROM published JOIN customer ON contains(text, replace(lower(c_name), '#', ' '))
  UNION ALL SELECT 'id', count(DISTINCT word), count(DISTINCT ein) FROM shown_words WHERE word IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer)
  UNION ALL SELECT 'amount', count(DISTINCT word), count(DISTINCT ein) FROM shown_words WHERE word IN (SELECT CAST(abs(x) AS VARCHAR) FROM (SELECT CAST(round(total_revenue) AS BIGINT) AS x FROM panel UNION SELECT CAST(round(total_expenses) AS BIGINT) FROM panel) WHERE abs(x) >= 1e5)"""


@query("a06_leak_audit", _AUDIT, "published", "shown_words", "panel")
def a06(spark, d):
    source = tp.panel(spark, d)
    n = c("ein").cast("int")
    planted = [F.when(n % 50 == 0, F.concat(F.lit(", like CUSTOMER "), F.lpad((n - 1).cast("string"), 9, "0"))), F.when(n % 70 == 0, F.concat(F.lit(" (EIN "), F.lpad("ein", 9, "0"), F.lit(")"))), F.when(n % 90 == 0, F.concat(F.lit(", exactly "), F.format_number("total_revenue", 0)))]
    text = F.concat(F.lit("Case "), c("case_index").cast("string"), F.lit(": revenue $"), c("new_revenue").cast("string"), *[F.coalesce(x, F.lit("")) for x in planted])
    every = secrets(spark, d).select("kind", "secret").unionByName(deid.amounts(source, ["total_revenue", "total_expenses"]))
    return deid.leak_audit(jittered(spark, d).select("ein", text.alias("text")), "ein", "text", every)


_SUM = "round(coalesce(pct_contributions, 0) * 100, 1) + round(coalesce(pct_program_revenue, 0) * 100, 1) + round(coalesce(pct_investment_income, 0) * 100, 1)"


@query(
    "a07_integrity_audit",
    f"""SELECT 'bad_margin' AS "check", count(*) FILTER (abs(operating_margin) > 2) AS violations FROM metrics UNION ALL SELECT 'share_out_of_range', count(*) FILTER (coalesce(pct_contributions, 0) > 1) FROM metrics
       UNION ALL SELECT 'shares_not_100', count(*) FILTER (abs({_SUM} - 100) > 0.11) FROM metrics UNION ALL SELECT 'nan_label', count(*) FILTER (cash_non_interest_bearing IS NULL) FROM metrics""",
    "metrics",
)
def a07(spark, d):
    """Rows whose fourth share was lost: their shares fall short of 100 where it was not 0."""
    z = lambda n: F.round(F.coalesce(n, F.lit(0.0)) * 100, 1).alias(n[4:])
    text = F.concat(F.lit("cash "), F.coalesce(c("cash_non_interest_bearing").cast("string"), F.lit("NaN")))
    rows = panel(spark, d).select("operating_margin", z("pct_contributions"), z("pct_program_revenue"), z("pct_investment_income"), F.lit(0.0).alias("other_revenue"), text.alias("text"))
    return profile.violations(rows, deid.integrity(["contributions", "program_revenue", "investment_income", "other_revenue"], "operating_margin", "text"))


@query("a07_published_integrity", "SELECT 'bad_margin' AS \"check\", count(*) FILTER (abs((new_revenue - new_expenses) / CAST(nullif(new_revenue, 0) AS DOUBLE)) > 2) AS violations FROM alias_money UNION ALL SELECT unnest(['share_out_of_range', 'shares_not_100', 'nan_label']), 0", "alias_money")
def a07b(spark, d):
    """The published rows themselves, of which none may fail."""
    margin = F.try_divide(c("new_revenue") - c("new_expenses"), c("new_revenue").cast("double"))
    rows = perturbed(spark, d).join(jittered(spark, d).select("ein", margin.alias("margin"), F.concat(F.lit("revenue "), c("new_revenue").cast("string")).alias("text")), "ein")
    return profile.violations(rows, deid.integrity(["a", "b", "c", "d"], "margin", "text"))
