"""Cohorts, benchmarks, gaps and confidence (B); stress, analogs and urgency (E); trend, labels and memo (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.config import BENCHMARKS, GAPS, METRICS
from ledgerline.functions import metrics as m
from ledgerline.operators import analogs, cohort, labels, merge, profile, stress
from ledgerline.plans import stages
from ledgerline.plans import testpanel as tp
from ledgerline.plans.oracle import add
from ledgerline.plans.reuse import cut
from ledgerline.queries.base import LARGEST, LARGEST_NAME
from ledgerline.registry import query

r6 = lambda c, name=None: F.round(c, 6).alias(name or c)
sql6 = lambda c: f"round({c}, 6) AS {c}"
KEY = ["ein", "fiscal_year"]

_L1 = "'ntee_major_category=' || ntee_major_category || '|size_bucket=' || size_bucket || '|state=' || state"
_L2 = "'size_bucket=' || size_bucket || '|state=' || state || '|return_type=' || return_type"
_L3 = "'size_bucket=' || size_bucket || '|state=' || state"
add("ok_rows", "SELECT * FROM eligible WHERE scoring_eligible", "eligible")
add(
    "assigned",
    f"""SELECT e.*, CASE WHEN n0 >= 10 THEN 'ntee+size_bucket+state' WHEN n1 >= 10 THEN 'size_bucket+state+return_type' ELSE 'size_bucket+state' END AS cohort_level,
      CASE WHEN n0 >= 10 THEN {_L1} WHEN n1 >= 10 THEN {_L2} ELSE {_L3} END AS cohort_key,
      CASE WHEN n0 >= 10 THEN n0 WHEN n1 >= 10 THEN n1 ELSE coalesce(n2, 0) END AS cohort_size
    FROM ok_rows e LEFT JOIN (SELECT ntee_major_category, size_bucket, state, count(DISTINCT ein) AS n0 FROM ok_rows WHERE ntee_major_category IS NOT NULL GROUP BY ALL) USING (ntee_major_category, size_bucket, state)
    LEFT JOIN (SELECT size_bucket, state, return_type, count(DISTINCT ein) AS n1 FROM ok_rows GROUP BY ALL) USING (size_bucket, state, return_type)
    LEFT JOIN (SELECT size_bucket, state, count(DISTINCT ein) AS n2 FROM ok_rows GROUP BY ALL) USING (size_bucket, state)""",
    "ok_rows",
)
add("targets", "SELECT DISTINCT cohort_key, cohort_level, fiscal_year AS target_year FROM assigned WHERE is_scoring_year", "assigned")
_Q = ", ".join(f"quantile_cont({x}, 0.75) AS q_{x}" for x in METRICS)
_TOPS = " + ".join(f"CAST(coalesce(a.{x} >= q.q_{x}, false) AS INT)" for x in METRICS)


def _windows(rows: str, wanted: str, prefix: str, *uses: str) -> None:
    """Quartiles, flags, benchmarks and peers of keyed rows, as the views prefix_q, prefix_f, prefix_b, prefix_p."""
    add(f"{prefix}q", f"SELECT cohort_key, fiscal_year, {_Q} FROM {rows} GROUP BY cohort_key, fiscal_year", *uses)
    add(f"{prefix}f", f"SELECT a.cohort_key, a.fiscal_year, a.ein, {_TOPS} AS tops FROM {rows} a JOIN {prefix}q q USING (cohort_key, fiscal_year)", *uses, f"{prefix}q")
    med = ", ".join(f"median(q_{x}) AS {b}" for x, b in zip(METRICS, BENCHMARKS))
    add(f"{prefix}b", f"SELECT t.cohort_key, t.target_year, {med} FROM {wanted} t JOIN {prefix}q q ON q.cohort_key = t.cohort_key AND q.fiscal_year BETWEEN t.target_year - 6 AND t.target_year GROUP BY ALL", f"{prefix}q")
    add(
        f"{prefix}p",
        f"""SELECT cohort_key, target_year, CASE WHEN p0 >= 5 THEN 1 ELSE 2 END AS step, CASE WHEN p0 >= 5 THEN '3-of-3_2-of-7' ELSE '2-of-3_2-of-7' END AS rule, CASE WHEN p0 >= 5 THEN p0 ELSE p1 END AS peers FROM (
          SELECT cohort_key, target_year, count(*) FILTER (y0 >= 2) AS p0, count(*) FILTER (y1 >= 2) AS p1 FROM (
            SELECT t.cohort_key, t.target_year, f.ein, count(*) FILTER (tops >= 3) AS y0, count(*) FILTER (tops >= 2) AS y1 FROM {wanted} t JOIN {prefix}f f ON f.cohort_key = t.cohort_key AND f.fiscal_year BETWEEN t.target_year - 6 AND t.target_year GROUP BY ALL) GROUP BY ALL)""",
        f"{prefix}f",
    )


_windows("assigned", "targets", "own_", "assigned", "targets")
add("poor", f"""SELECT DISTINCT p.cohort_key, p.target_year, l.broader_key FROM own_p p JOIN (SELECT DISTINCT cohort_key, CASE cohort_level WHEN 'ntee+size_bucket+state' THEN {_L2} WHEN 'size_bucket+state+return_type' THEN {_L3} END AS broader_key FROM assigned) l USING (cohort_key) WHERE p.peers < 5 AND broader_key IS NOT NULL""", "own_p", "assigned")
add("wide", f"SELECT * REPLACE ({_L2} AS cohort_key) FROM assigned UNION ALL SELECT * REPLACE ({_L3} AS cohort_key) FROM assigned", "assigned")
add("again", "SELECT DISTINCT broader_key AS cohort_key, target_year FROM poor", "poor")
_windows("wide", "again", "up_", "wide", "again")
_SWAP = ", ".join(f"CASE WHEN up.peers >= 5 THEN ub.{b} ELSE ob.{b} END AS {b}" for b in BENCHMARKS)
add(
    "bench",
    f"""SELECT o.cohort_key, o.target_year, CASE WHEN up.peers IS NOT NULL THEN 3 ELSE o.step END AS step, CASE WHEN up.peers >= 5 THEN up.rule ELSE o.rule END AS rule, CASE WHEN up.peers >= 5 THEN up.peers ELSE o.peers END AS peers, {_SWAP},
      CASE WHEN CASE WHEN up.peers >= 5 THEN up.peers ELSE o.peers END >= 5 THEN 'ok' ELSE 'insufficient_resilient_refs' END AS benchmark_status
    FROM own_p o JOIN own_b ob USING (cohort_key, target_year) LEFT JOIN poor USING (cohort_key, target_year) LEFT JOIN up_p up ON up.cohort_key = poor.broader_key AND up.target_year = poor.target_year LEFT JOIN up_b ub ON ub.cohort_key = poor.broader_key AND ub.target_year = poor.target_year""",
    "own_p", "own_b", "poor", "up_p", "up_b",
)
_STATS = ", ".join(f"avg(a.{x}) AS mu_{x}, stddev_pop(a.{x}) AS sd_{x}, count(a.{x}) AS n_{x}" for x in METRICS)
add("stats", f"SELECT t.cohort_key, t.target_year, {_STATS} FROM targets t JOIN assigned a ON a.cohort_key = t.cohort_key AND a.fiscal_year BETWEEN t.target_year - 6 AND t.target_year GROUP BY ALL", "targets", "assigned")
_ZS = ", ".join(f"CASE WHEN n_{x} < 2 OR sd_{x} = 0 THEN 0.0 ELSE (a.{x} - mu_{x}) / sd_{x} END AS z_{x}" for x in METRICS)
_GAPS = ", ".join(f"a.{x} - b.{k} AS {g}" for x, k, g in zip(METRICS, BENCHMARKS, GAPS))
add(
    "conf",
    """SELECT ein, fiscal_year, window_years, null_rate, CASE WHEN window_years >= 6 AND null_rate < 0.2 THEN 'High' WHEN window_years <= 3 OR null_rate > 0.2 THEN 'Low' ELSE 'Medium' END AS data_confidence_tier,
      CASE WHEN window_years >= 6 AND null_rate < 0.2 THEN NULL WHEN window_years <= 3 THEN window_years || ' years in window' WHEN null_rate > 0.2 THEN 'null rate ' || CAST(round(null_rate * 100) AS INT) || '%' WHEN window_years <= 5 THEN window_years || ' years in window' ELSE 'null rate ' || CAST(round(null_rate * 100) AS INT) || '%' END AS data_reason
    FROM (SELECT a.ein, a.fiscal_year, count(DISTINCT b.fiscal_year) AS window_years, sum(CAST(b.total_revenue IS NULL AS INT) + CAST(b.total_expenses IS NULL AS INT) + CAST(b.net_assets_eoy IS NULL AS INT) + CAST(b.cash_non_interest_bearing IS NULL AS INT) + CAST(b.savings_temporary_investments IS NULL AS INT)) / (count(*) * 5) AS null_rate
      FROM panel a JOIN panel b ON a.ein = b.ein AND b.fiscal_year BETWEEN a.fiscal_year - 6 AND a.fiscal_year GROUP BY ALL)""",
    "panel",
)
add(
    "benchmarked",
    f"""SELECT *, CASE WHEN data_confidence_tier = 'Low' OR cohort_confidence_tier = 'Low' THEN 'Low' WHEN data_confidence_tier = 'Medium' OR cohort_confidence_tier = 'Medium' THEN 'Medium' ELSE 'High' END AS checkpoint1_confidence_tier,
      coalesce(nullif(concat_ws('; ', data_reason, CASE WHEN cohort_level <> 'ntee+size_bucket+state' THEN 'fallback cohort: ' || cohort_level END), ''), 'primary data quality; primary cohort') AS confidence_reason FROM (
    SELECT *, -list_avg(list_filter([z_{METRICS[0]}, z_{METRICS[1]}, z_{METRICS[2]}], lambda z: z IS NOT NULL)) AS resilience_gap, CASE cohort_level WHEN 'ntee+size_bucket+state' THEN 'High' WHEN 'size_bucket+state+return_type' THEN 'Medium' ELSE 'Low' END AS cohort_confidence_tier FROM (
      SELECT a.*, {_ZS}, {_GAPS}, b.step, b.rule, b.peers, b.benchmark_status, {', '.join('b.' + b for b in BENCHMARKS)}, c.window_years, c.null_rate, c.data_confidence_tier, c.data_reason
      FROM assigned a LEFT JOIN stats s ON a.cohort_key = s.cohort_key AND a.fiscal_year = s.target_year LEFT JOIN bench b ON a.cohort_key = b.cohort_key AND a.fiscal_year = b.target_year JOIN conf c ON a.ein = c.ein AND a.fiscal_year = c.fiscal_year WHERE a.is_scoring_year))""",
    "assigned", "stats", "bench", "conf",
)
_OK = "(total_revenue > 0 AND total_expenses IS NOT NULL AND net_assets_eoy IS NOT NULL AND cash_non_interest_bearing IS NOT NULL AND savings_temporary_investments IS NOT NULL)"


def _stress_sql(source: str) -> str:
    shock = ""
    for n, s in (("25pct", 0.25), ("50pct", 0.5)):
        shock += f""", CASE WHEN ok THEN total_revenue - largest_revenue_source_pct * total_revenue * {s} END AS stress_{n}_post_shock_revenue,
          CASE WHEN ok AND total_revenue - largest_revenue_source_pct * total_revenue * {s} < total_expenses THEN (cash_non_interest_bearing + savings_temporary_investments) / ((total_expenses - (total_revenue - largest_revenue_source_pct * total_revenue * {s})) / 12) END AS stress_{n}_burn_months"""
    sev = "".join(
        f""", CASE WHEN NOT ok THEN NULL WHEN net_assets_eoy < 0 OR stress_{n}_post_shock_revenue < 0 THEN 'critical' WHEN stress_{n}_post_shock_revenue >= total_expenses THEN 'none' WHEN stress_{n}_burn_months < 1 THEN 'critical' WHEN stress_{n}_burn_months <= 6 THEN 'severe' WHEN stress_{n}_burn_months <= 24 THEN 'moderate' ELSE 'mild' END AS stress_{n}_severity"""
        for n in ("25pct", "50pct")
    )
    return f"""SELECT *, CASE WHEN ok THEN 'computed' ELSE 'not_applicable' END AS stress_test_status {sev} FROM (SELECT * {shock} FROM (
      SELECT *, {_OK} AS ok, CASE WHEN {_OK} THEN {LARGEST_NAME} END AS largest_revenue_source, CASE WHEN {_OK} THEN {LARGEST} / total_revenue END AS largest_revenue_source_pct FROM {source}))"""


_URGENT = "coalesce(shock_absorption_months < 3 AND operating_margin < 0, false)"
_ACUTE = "coalesce(shock_absorption_months < 1 AND operating_margin < -0.1, false)"
_URGENCY = f"""{_URGENT} AS urgency_flag, CASE WHEN {_ACUTE} THEN 'acute' WHEN {_URGENT} THEN 'flagged' ELSE 'none' END AS urgency_severity,
  CASE WHEN {_ACUTE} THEN 'negative_margin_and_lt1m_shock_absorption_and_margin_below_neg10pct' WHEN {_URGENT} THEN 'negative_margin_and_lt3m_shock_absorption' ELSE 'none' END AS urgency_reason"""
add("stressed_panel", _stress_sql("metrics"), "metrics")
add("stressed", _stress_sql("benchmarked"), "benchmarked")
_MG, _RG, _DG = GAPS
_LEAST = f"least({_MG}, {_RG}, {_DG})"
_PICK = lambda a, b, c: f"CASE WHEN {_MG} = {_LEAST} THEN '{a}' WHEN {_RG} = {_LEAST} THEN '{b}' WHEN {_DG} = {_LEAST} THEN '{c}' END"
add("urgent", f"SELECT *, {_URGENCY}, {_PICK(*analogs.CONSTRAINTS)} AS constraint_label, {_PICK(*METRICS)} AS constraint_metric FROM stressed", "stressed")
add("pool_rows", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT ein, fiscal_year, state, org_name, ntee_major_category, size_bucket, total_revenue, '{x}' AS metric, {x} AS value FROM metrics" for x in METRICS) + ") WHERE value IS NOT NULL AND ein IN (SELECT ein FROM panel GROUP BY ein HAVING count(DISTINCT fiscal_year) >= 3)", "metrics", "panel")
add("limits", "SELECT metric, fiscal_year, 'pre' AS side, quantile_cont(value, 0.25) AS threshold FROM pool_rows WHERE fiscal_year BETWEEN 1995 AND 1997 GROUP BY ALL UNION ALL SELECT metric, fiscal_year, 'post', quantile_cont(value, 0.75) FROM pool_rows WHERE fiscal_year BETWEEN 1998 AND 2001 GROUP BY ALL", "pool_rows")
add(
    "pool",
    """SELECT metric, ein AS peer, pre_year, pre_value, post_year, post_value, peer_state, peer_name, peer_sector, size_bucket, peer_revenue FROM
      (SELECT metric, ein, max(fiscal_year) AS pre_year, max_by(value, fiscal_year) AS pre_value FROM pool_rows r JOIN limits l USING (metric, fiscal_year) WHERE side = 'pre' AND value <= threshold GROUP BY ALL)
      JOIN (SELECT metric, ein, fiscal_year AS post_year, value AS post_value, state AS peer_state, org_name AS peer_name, ntee_major_category AS peer_sector, size_bucket, total_revenue AS peer_revenue FROM (
        SELECT r.*, row_number() OVER (PARTITION BY metric, ein ORDER BY fiscal_year DESC) AS rn FROM pool_rows r JOIN limits l USING (metric, fiscal_year) WHERE side = 'post' AND value >= threshold) WHERE rn = 1) USING (metric, ein)""",
    "pool_rows", "limits",
)
add(
    "matched",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein, fiscal_year ORDER BY NOT strict, peer_state = state DESC, abs(peer_revenue / total_revenue - 1), post_year DESC, CAST(peer AS DOUBLE)) AS rank FROM (
      SELECT *, max(CAST(strict AS INT)) OVER (PARTITION BY ein, fiscal_year) AS any_strict FROM (
        SELECT u.ein, u.fiscal_year, u.state, u.total_revenue, u.constraint_label, p.*, coalesce(u.ntee_major_category = p.peer_sector, false) AS strict FROM urgent u JOIN pool p ON p.metric = u.constraint_metric AND p.size_bucket = u.size_bucket AND p.peer <> u.ein WHERE u.benchmark_status = 'ok')) WHERE strict OR any_strict = 0) WHERE rank <= 3""",
    "urgent", "pool",
)
add(
    "labelled",
    f"""SELECT *, CASE WHEN deep THEN 'Needs Data Diligence' WHEN good THEN 'Underinvested Asset Base' WHEN narrow THEN 'Revenue Concentration Risk' ELSE 'Weak Financial Foundation' END AS action_label FROM (
      SELECT u.*, CASE WHEN u.benchmark_status = 'ok' THEN constraint_label END AS recovery_analog_constraint, coalesce(m.n, 0) AS recovery_analog_count, coalesce(m.eins, '') AS recovery_analog_eins,
        m.e1, CASE WHEN u.benchmark_status <> 'ok' OR constraint_label IS NULL THEN 'not_applicable' WHEN m.n IS NULL THEN 'none_in_cohort' ELSE 'found' END AS recovery_analog_status,
        CASE WHEN u.fiscal_year = 2001 AND u.resilience_gap <= b.resilience_gap + 0.1 THEN 'improving' WHEN u.fiscal_year = 2001 AND u.resilience_gap > b.resilience_gap + 0.1 THEN 'declining' ELSE 'unavailable' END AS trend_direction,
        u.benchmark_status = 'insufficient_resilient_refs' OR checkpoint1_confidence_tier = 'Low' OR (urgency_severity = 'acute' AND coalesce(stress_25pct_severity IN ('severe', 'critical'), false)) OR coalesce(u.resilience_gap > 2, false) AS deep,
        coalesce({_MG} >= 0 AND {_RG} >= 0 AND {_DG} >= 0, false) AND NOT coalesce(stress_25pct_severity IN ('severe', 'critical'), false) AND urgency_severity = 'none' AS good,
        coalesce({_DG} <= -0.3 AND {_MG} >= -0.3, false) AND NOT coalesce(stress_25pct_severity IN ('severe', 'critical'), false) AND urgency_severity = 'none' AS narrow
      FROM urgent u LEFT JOIN (SELECT ein, fiscal_year, count(*) AS n, string_agg(peer, ',' ORDER BY rank) AS eins, min_by(struct_pack(org_name := peer_name, state := peer_state, y0 := pre_year, y1 := post_year, metric := metric, v0 := round(pre_value, 6), v1 := round(post_value, 6)), rank) AS e1 FROM matched GROUP BY ALL) m USING (ein, fiscal_year)
      LEFT JOIN (SELECT ein, resilience_gap FROM urgent WHERE fiscal_year = 2000) b ON u.ein = b.ein)""",
    "urgent", "matched",
)


def assigned(spark, d):
    return stages.assigned(tp.panel(spark, d), tp.CONFIG, *stages.COMPARED)


@query("b01_cohort_sizes", "SELECT 0 AS level, count(*) AS cohorts, sum(n) AS members FROM (SELECT count(DISTINCT ein) AS n FROM ok_rows WHERE ntee_major_category IS NOT NULL GROUP BY ntee_major_category, size_bucket, state) UNION ALL SELECT 1, count(*), sum(n) FROM (SELECT count(DISTINCT ein) AS n FROM ok_rows GROUP BY size_bucket, state, return_type) UNION ALL SELECT 2, count(*), sum(n) FROM (SELECT count(DISTINCT ein) AS n FROM ok_rows GROUP BY size_bucket, state)", "ok_rows")
def b01(spark, d):
    out = None
    for i, s in enumerate(cohort.sizes(stages.measured(tp.panel(spark, d)).where("scoring_eligible"))):
        one = s.agg(F.lit(i).alias("level"), F.count("*").alias("cohorts"), F.sum(f"n{i}").alias("members"))
        out = one if out is None else out.unionByName(one)
    return out


@query("b02_cohort_fallback", "SELECT ein, fiscal_year, cohort_level, cohort_size FROM assigned", "assigned")
def b02(spark, d):
    return assigned(spark, d).select(*KEY, "cohort_level", "cohort_size")


@query("b03_cohort_key", "SELECT ein, fiscal_year, cohort_key FROM assigned", "assigned")
def b03(spark, d):
    return assigned(spark, d).select(*KEY, "cohort_key")


@query("b04_window_population", "SELECT t.cohort_key, t.target_year, count(*) AS n_rows, count(DISTINCT ein) AS entities FROM targets t JOIN assigned a ON a.cohort_key = t.cohort_key AND a.fiscal_year BETWEEN t.target_year - 6 AND t.target_year GROUP BY ALL", "targets", "assigned")
def b04(spark, d):
    a = assigned(spark, d)
    w = cohort.windowed(a.select("cohort_key", *KEY), cohort.targets(a.where("is_scoring_year")))
    return w.groupBy("cohort_key", "target_year").agg(F.count("*").alias("n_rows"), F.countDistinct("ein").alias("entities"))


@query("b05_q75_median", f"SELECT cohort_key, target_year, {', '.join(map(sql6, BENCHMARKS))} FROM own_b", "own_b")
def b05(spark, d):
    a = assigned(spark, d)
    return cohort.benchmarks(cohort.yearly_quartiles(a), cohort.targets(a.where("is_scoring_year"))).select("cohort_key", "target_year", *map(r6, BENCHMARKS))


@query("b06_top_quartile_flags", f"SELECT a.ein, a.fiscal_year, {', '.join(f'a.{x} >= q.q_{x} AS top_{x}' for x in METRICS)} FROM assigned a JOIN own_q q USING (cohort_key, fiscal_year)", "assigned", "own_q")
def b06(spark, d):
    a = assigned(spark, d)
    return cohort.flags(a, cohort.yearly_quartiles(a)).select(*KEY, *[f"top_{x}" for x in METRICS])


@query("b07_persistence_ladder", "SELECT cohort_key, target_year, step, rule, peers FROM own_p", "own_p")
def b07(spark, d):
    a = assigned(spark, d)
    return cohort.resilient(a, cohort.yearly_quartiles(a), cohort.targets(a.where("is_scoring_year")), tp.CONFIG)


@query("b08_broadening", f"SELECT cohort_key, target_year, step, rule, peers, {', '.join(map(sql6, BENCHMARKS))} FROM bench", "bench")
def b08(spark, d):
    return cohort.build(assigned(spark, d), tp.CONFIG).select("cohort_key", "target_year", "step", "rule", "peers", *map(r6, BENCHMARKS))


@query("b09_benchmark_status", "SELECT benchmark_status, count(*) AS n FROM bench GROUP BY 1", "bench")
def b09(spark, d):
    return cohort.build(assigned(spark, d), tp.CONFIG).groupBy("benchmark_status").agg(F.count("*").alias("n"))


def benchmarked(spark, d):
    return stages.benchmarked(tp.panel(spark, d), tp.CONFIG)


@query("b10_gaps", f"SELECT ein, fiscal_year, {', '.join(map(sql6, GAPS))} FROM benchmarked", "benchmarked")
def b10(spark, d):
    return benchmarked(spark, d).select(*KEY, *map(r6, GAPS))


@query("b11_z_composite", f"SELECT ein, fiscal_year, {', '.join(sql6('z_' + x) for x in METRICS)}, {sql6('resilience_gap')} FROM benchmarked", "benchmarked")
def b11(spark, d):
    a = assigned(spark, d)
    return cohort.z_scores(a.where("is_scoring_year"), a).select(*KEY, *[r6(f"z_{x}") for x in METRICS], r6("resilience_gap"))


@query("b12_data_confidence", "SELECT ein, fiscal_year, window_years, round(null_rate, 6) AS null_rate, data_confidence_tier FROM conf", "conf")
def b12(spark, d):
    return cohort.confidence(tp.panel(spark, d)).select(*KEY, "window_years", r6("null_rate"), "data_confidence_tier")


@query("b13_min_tier", "SELECT ein, fiscal_year, cohort_confidence_tier, checkpoint1_confidence_tier FROM benchmarked", "benchmarked")
def b13(spark, d):
    return benchmarked(spark, d).select(*KEY, "cohort_confidence_tier", "checkpoint1_confidence_tier")


@query("b14_confidence_reason", "SELECT ein, fiscal_year, confidence_reason FROM benchmarked", "benchmarked")
def b14(spark, d):
    return benchmarked(spark, d).select(*KEY, "confidence_reason")


# --- stress, analogs, urgency ---------------------------------------------------------------------------------------

_NUM = [f"stress_{n}_{x}" for n in ("25pct", "50pct") for x in ("post_shock_revenue", "burn_months")]


def stressed(spark, d):
    return stress.shocks(m.with_metrics(tp.panel(spark, d)))


@query("e01_shock_scenarios", f"SELECT ein, fiscal_year, largest_revenue_source, round(largest_revenue_source_pct, 6) AS share, {', '.join(f'round({c}, 6) AS {c}' for c in _NUM)} FROM stressed_panel", "stressed_panel")
def e01(spark, d):
    return stressed(spark, d).select(*KEY, "largest_revenue_source", r6("largest_revenue_source_pct", "share"), *[F.round(c, 6).alias(c) for c in _NUM])


@query("e02_severity", "SELECT ein, fiscal_year, stress_25pct_severity, stress_50pct_severity FROM stressed_panel", "stressed_panel")
def e02(spark, d):
    return stressed(spark, d).select(*KEY, "stress_25pct_severity", "stress_50pct_severity")


@query("e03_computability", "SELECT stress_test_status, count(*) AS n FROM stressed_panel GROUP BY 1", "stressed_panel")
def e03(spark, d):
    return stressed(spark, d).groupBy("stress_test_status").agg(F.count("*").alias("n"))


_RUN = lambda s: f"CASE WHEN total_expenses <= 0 OR total_expenses - (total_revenue - {LARGEST} * {s}) <= 0 THEN 120.0 ELSE least(120.0, (coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0)) / ((total_expenses - (total_revenue - {LARGEST} * {s})) / 12)) END"
_BAND = lambda c: f"CASE WHEN {c} < 1 THEN 'Severe' WHEN {c} < 3 THEN 'Moderate' WHEN {c} < 6 THEN 'Mild' ELSE 'None' END"
add("deficits", f"SELECT *, {_RUN('0.0')} AS burn0, {_RUN('0.25')} AS burn25, {_RUN('0.5')} AS burn50, CASE WHEN total_revenue > 0 THEN least(greatest({LARGEST} / total_revenue * 100, 0.0), 100.0) ELSE 0.0 END AS largest_pct, {LARGEST_NAME} AS largest_name FROM metrics", "metrics")


@query("e04_deficit_stress", f"SELECT ein, fiscal_year, round(burn0, 6) AS burn0, round(burn25, 6) AS burn25, round(burn50, 6) AS burn50, round(largest_pct, 6) AS largest_pct, {_BAND('burn25')} AS severity25, {_BAND('burn50')} AS severity50 FROM deficits", "deficits")
def e04(spark, d):
    return stress.deficit_stress(tp.panel(spark, d)).select(*KEY, r6("burn0"), r6("burn25"), r6("burn50"), r6("largest_pct"), "severity25", "severity50")


@query(
    "e05_shock_interpolation",
    """SELECT ein, fiscal_year, shock, round(CASE WHEN shock <= 25 THEN burn0 + (burn25 - burn0) * shock / 25 WHEN shock <= 50 THEN burn25 + (burn50 - burn25) * (shock - 25) / 25
       ELSE burn50 + (greatest(0, burn50 - greatest(0, burn25 - burn50)) - burn50) * (shock - 50) / 25 END, 6) AS runway FROM deficits, (SELECT unnest([10, 40, 60]) AS shock)""",
    "deficits",
)
def e05(spark, d):
    df = stress.deficit_stress(tp.panel(spark, d)).withColumn("shock", F.explode(F.array(F.lit(10), F.lit(40), F.lit(60))))
    return df.select(*KEY, "shock", F.round(stress.interpolated(F.col("shock"), F.col("burn0"), F.col("burn25"), F.col("burn50")), 6).alias("runway"))


@query("e06_national_quartiles", "SELECT metric, fiscal_year, side, round(threshold, 6) AS threshold FROM limits", "limits")
def e06(spark, d):
    p = m.with_metrics(tp.panel(spark, d))
    enough = p.groupBy("ein").agg(F.countDistinct("fiscal_year").alias("n")).where("n >= 3")
    return analogs.year_thresholds(p.join(enough.select("ein"), "ein", "left_semi")).select("metric", "fiscal_year", "side", r6("threshold"))


@query("e07_recovery_pool", "SELECT metric, peer, pre_year, round(pre_value, 6) AS pre_value, post_year, round(post_value, 6) AS post_value FROM pool", "pool")
def e07(spark, d):
    return analogs.pool(m.with_metrics(tp.panel(spark, d))).select("metric", "peer", "pre_year", r6("pre_value"), "post_year", r6("post_value"))


@query("e08_primary_constraint", "SELECT ein, fiscal_year, constraint_label FROM urgent", "urgent")
def e08(spark, d):
    return benchmarked(spark, d).select(*KEY, analogs.constraint()["label"].alias("constraint_label"))


@query("e09_analog_match", "SELECT ein, fiscal_year, peer, rank FROM matched", "matched")
def e09(spark, d):
    panel = cut(tp.panel(spark, d))
    pool = cut(analogs.pool(m.with_metrics(panel)))
    return analogs.match(stages.compared(stages.assigned(panel, tp.CONFIG, *stages.COMPARED), tp.CONFIG), pool).select(*KEY, "peer", "rank")


@query("e10_evidence", "SELECT ein, fiscal_year, recovery_analog_eins, recovery_analog_count, recovery_analog_constraint, recovery_analog_status, e1.org_name AS first_name, e1.v1 AS first_post_value FROM labelled", "labelled")
def e10(spark, d):
    e = F.try_element_at("recovery_analog_evidence", F.lit(1))
    return stages.recovered(tp.panel(spark, d), tp.CONFIG).select(*KEY, F.array_join("recovery_analog_eins", ",").alias("recovery_analog_eins"), "recovery_analog_count", "recovery_analog_constraint", "recovery_analog_status", e["org_name"].alias("first_name"), e["matched_metric_post_value"].alias("first_post_value"))


@query("e11_urgency", f"SELECT ein, fiscal_year, {_URGENCY} FROM metrics", "metrics")
def e11(spark, d):
    return stress.urgency(m.with_metrics(tp.panel(spark, d))).select(*KEY, "urgency_flag", "urgency_severity", "urgency_reason")


add("acute", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) AS rn FROM deficits) WHERE rn = 1 AND shock_absorption_months < 3 AND operating_margin < 0 AND ntee_major_category IS NOT NULL", "deficits")
add(
    "near_peers",
    """SELECT a.ein AS target, a.total_revenue AS own, CASE WHEN a.revenue_diversification_index < 0.3 THEN 'revenue_diversification_index' WHEN a.operating_runway_proxy_months < 12 THEN 'operating_runway_proxy_months' ELSE 'operating_margin' END AS metric,
       p.ein AS peer, p.fiscal_year, p.state = a.state AND p.total_revenue BETWEEN a.total_revenue * 0.3 AND a.total_revenue * 3 AS near, p.burn0, p.operating_margin, p.revenue_diversification_index FROM acute a JOIN deficits p ON p.ntee_major_category = a.ntee_major_category AND p.ein <> a.ein""",
    "acute", "deficits",
)
add(
    "gained",
    """SELECT target, peer, metric, CASE WHEN n >= 5 AND v1 - v5 > need THEN v5 WHEN v1 - v4 > need THEN v4 ELSE v3 END AS pre_value, v1 AS post_value, 'FY' || CASE WHEN n >= 5 AND v1 - v5 > need THEN y5 WHEN v1 - v4 > need THEN y4 ELSE y3 END || '-FY' || y1 AS recovery_window FROM (
      SELECT target, peer, metric, count(*) AS n, CASE metric WHEN 'operating_margin' THEN 0.1 WHEN 'operating_runway_proxy_months' THEN 6.0 ELSE 0.2 END AS need,
        max(v) FILTER (back = 1) AS v1, max(v) FILTER (back = 3) AS v3, max(v) FILTER (back = 4) AS v4, max(v) FILTER (back = 5) AS v5, max(fiscal_year) FILTER (back = 1) AS y1, max(fiscal_year) FILTER (back = 3) AS y3, max(fiscal_year) FILTER (back = 4) AS y4, max(fiscal_year) FILTER (back = 5) AS y5
      FROM (SELECT *, CASE metric WHEN 'operating_margin' THEN operating_margin WHEN 'operating_runway_proxy_months' THEN burn0 ELSE revenue_diversification_index END AS v, row_number() OVER (PARTITION BY target, peer ORDER BY fiscal_year DESC) AS back
        FROM near_peers WHERE near OR target NOT IN (SELECT target FROM near_peers WHERE near)) GROUP BY ALL)
    WHERE n >= 4 AND (v1 - v3 > need OR v1 - v4 > need OR (n >= 5 AND v1 - v5 > need))""",
    "near_peers",
)


@query("e12_improvement_analogs", "SELECT target, peer, metric, round(pre_value, 6) AS pre_value, round(post_value, 6) AS post_value, recovery_window, rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(post_value - pre_value, 9) DESC, peer) AS rank FROM gained) WHERE rank <= 3", "gained")
def e12(spark, d):
    p = m.with_metrics(stress.deficit_stress(tp.panel(spark, d))).withColumnRenamed("burn0", "deficit_runway")
    p = cut(p.select(*KEY, "tax_period_end", "ntee_major_category", "state", "total_revenue", "deficit_runway", "shock_absorption_months", *METRICS))
    acute = stress.urgency(merge.latest_row(p)).where("urgency_flag")
    return analogs.improvements(acute, p).select("target", "peer", "metric", r6("pre_value"), r6("post_value"), "recovery_window", "rank")


# --- trend, labels, memo --------------------------------------------------------------------------------------------


def labelled(spark, d):
    return stages.labelled(tp.panel(spark, d), tp.CONFIG)


@query("l01_trend", "SELECT ein, fiscal_year, trend_direction FROM labelled", "labelled")
def l01(spark, d):
    return labels.trend(benchmarked(spark, d), 2000, 2001).select(*KEY, "trend_direction")


@query("l02_action_label", "SELECT ein, fiscal_year, action_label FROM labelled", "labelled")
def l02(spark, d):
    return labels.label(stress.urgency(stress.shocks(benchmarked(spark, d)))).select(*KEY, "action_label")


_WEAK = _PICK(*labels.STRENGTHEN_RULES[1])
add(
    "reasoned",
    f"""SELECT *, CASE WHEN deep THEN concat_ws(',', CASE WHEN benchmark_status = 'insufficient_resilient_refs' THEN '{labels.REVIEW_RULES[0]}' END, CASE WHEN checkpoint1_confidence_tier = 'Low' THEN '{labels.REVIEW_RULES[1]}' END,
      CASE WHEN urgency_severity = 'acute' AND stress_25pct_severity IN ('severe', 'critical') THEN '{labels.REVIEW_RULES[2]}' END, CASE WHEN resilience_gap > 2 THEN '{labels.REVIEW_RULES[3]}' END)
      WHEN good THEN '{",".join(labels.OPTIMISE_RULES)}' WHEN narrow THEN '{",".join(labels.DIVERSIFY_RULES)}' ELSE concat_ws(',', '{labels.STRENGTHEN_RULES[0]}', {_WEAK}) END AS rationale FROM labelled""",
    "labelled",
)


@query("l03_rationale", "SELECT ein, fiscal_year, rationale FROM reasoned", "reasoned")
def l03(spark, d):
    return labels.label(stress.urgency(stress.shocks(benchmarked(spark, d)))).select(*KEY, F.array_join("action_label_rationale", ",").alias("rationale"))


@query("l04_corrupt_rows", f"SELECT 'corrupt' AS \"check\", count(*) FILTER (action_label = 'Weak Financial Foundation' AND coalesce({_MG}, {_RG}, {_DG}) IS NULL) AS violations FROM labelled", "labelled")
def l04(spark, d):
    df = labels.label(stress.urgency(stress.shocks(benchmarked(spark, d))))
    return profile.violations(df, {"corrupt": labels.corrupt(df)})


_PHRASE = lambda g: f"CASE WHEN {g} IS NULL THEN 'unavailable' WHEN {g} >= 0 THEN 'above peer benchmark' WHEN {g} >= -0.3 THEN 'near peer benchmark' WHEN {g} >= -1.0 THEN 'below peer benchmark' ELSE 'materially behind peer benchmark' END"


@query("l05_gap_phrase", f"SELECT ein, fiscal_year, {_PHRASE(_MG)} AS margin, {_PHRASE(_RG)} AS runway, {_PHRASE(_DG)} AS mix FROM benchmarked", "benchmarked")
def l05(spark, d):
    return benchmarked(spark, d).select(*KEY, *[labels.gap_phrase(F.col(g)).alias(n) for g, n in zip(GAPS, ("margin", "runway", "mix"))])


_N = lambda c, k=2: f"coalesce(format('{{:.{k}f}}', {c}), 'null')"
_THREE = f"'argin gap ' || {_N(_MG)} || ', runway gap ' || {_N(_RG)} || ', and diversification gap ' || {_N(_DG)}"
_VS = lambda w, v, b, g, k: f"'{w} ' || {_N(v, k)} || ' vs ' || {_N(b, k)} || ' (' || {_PHRASE(g)} || ')'"
_CW = "coalesce(replace(recovery_analog_constraint, '_', ' '), 'constraint')"
add(
    "memos",
    f"""SELECT *, concat_ws(' ', org_name || ' (' || state || ') FY' || fiscal_year || ', ' || size_bucket || ', revenue $' || format('{{:,.0f}}', total_revenue) || '.',
      'Cohort: ' || coalesce(ntee_major_category, 'unclassified') || ', ' || cohort_size || ' orgs, benchmark rule ' || rule || '.',
      'Resilience: ' || {_VS('margin', METRICS[0], BENCHMARKS[0], _MG, 2)} || '; ' || {_VS('runway', METRICS[1], BENCHMARKS[1], _RG, 1)} || '; ' || {_VS('diversification', METRICS[2], BENCHMARKS[2], _DG, 2)} || '.' || CASE WHEN trend_direction = 'unavailable' THEN '' ELSE ' Trend is ' || trend_direction || '.' END,
      CASE WHEN stress_test_status <> 'computed' THEN 'Stress test: unavailable due to missing raw inputs.' ELSE 'Stress test: a 25% shock to the largest revenue source yields ' || CASE WHEN stress_25pct_burn_months IS NULL THEN 'no burn-month estimate' ELSE 'burn months ' || {_N('stress_25pct_burn_months', 1)} END || ' with severity ' || stress_25pct_severity || '.' END,
      coalesce(e1.org_name || ' (' || e1.state || ') recovered from a similar ' || {_CW} || ' position between ' || e1.y0 || ' and ' || e1.y1 || ', improving ' || e1.metric || ' from ' || format('{{:.2f}}', e1.v0) || ' to ' || format('{{:.2f}}', e1.v1) || '.', 'Recovery analog evidence is unavailable.'),
      'Recommended action: ' || action_label || '. ' || CASE action_label WHEN 'Underinvested Asset Base' THEN 'M' || {_THREE} || ' are all above benchmark, with 25% stress severity ' || coalesce(stress_25pct_severity, 'None') || ' and urgency ' || urgency_severity || '.'
        WHEN 'Revenue Concentration Risk' THEN 'Diversification gap ' || {_N(_DG)} || ' is materially below benchmark while margin gap ' || {_N(_MG)} || ' remains above the -0.30 floor and 25% stress severity is ' || coalesce(stress_25pct_severity, 'None') || '.'
        WHEN 'Needs Data Diligence' THEN 'This row triggered ' || replace(rationale, ',', ', ') || ', with benchmark status ' || benchmark_status || ', confidence ' || checkpoint1_confidence_tier || ', and resilience gap ' || {_N('resilience_gap')} || '.'
        ELSE 'Primary constraint is ' || {_CW} || ' with m' || {_THREE} || '.' END,
      CASE WHEN checkpoint1_confidence_tier = 'Low' AND urgency_severity = 'acute' THEN 'Confidence: Low. The data points to possible imminent distress; verify current filings before any capital decision.' WHEN checkpoint1_confidence_tier = 'Low' THEN 'Confidence: Low. The data does not support a specific recommendation; review the row directly before action.'
        WHEN checkpoint1_confidence_tier = 'Medium' THEN 'Confidence: Medium. Moderate confidence due to filing or cohort limitations.' ELSE 'Confidence: High.' END) AS memo_text FROM reasoned""",
    "reasoned",
)


@query("l06_memo", "SELECT ein, fiscal_year, memo_text FROM memos", "memos")
def l06(spark, d):
    return labelled(spark, d).select(*KEY, "memo_text")


_NA = lambda c, k=2: f"coalesce(format('{{:.{k}f}}', {c}), 'N/A')"
_OF = lambda name, v, b, g, unit="": f"'{name} of ' || {_NA(v)} || '{unit} versus benchmark ' || {_NA(b)} || '{unit} (' || {_PHRASE(g)} || ').'"
_PLAIN = "CASE recovery_analog_constraint WHEN 'low_margin' THEN 'low operating margin' WHEN 'low_runway' THEN 'low operating runway' WHEN 'high_concentration_in_volatile_source' THEN 'high revenue concentration' ELSE 'unspecified constraint' END"
_SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.REVIEW_WORDS.items())
add(
    "sentences",
    f"""SELECT *, concat_ws(' ', org_name || ' (' || state || ', FY' || fiscal_year || ', ' || coalesce(size_bucket, 'N/A') || ', revenue ' || CASE WHEN abs(total_revenue) >= 1e6 THEN '$' || format('{{:,.1f}}', total_revenue / 1e6) || 'M' WHEN abs(total_revenue) >= 1e3 THEN '$' || format('{{:,.0f}}', total_revenue / 1e3) || 'K' ELSE '$' || format('{{:,.0f}}', total_revenue) END || ').',
      'Benchmarked within ' || coalesce('NTEE category ' || ntee_major_category, 'unclassified sector') || ', cohort of ' || cohort_size || ' peers, rule: ' || coalesce(rule, 'N/A') || '.',
      {_OF('Operating margin', METRICS[0], BENCHMARKS[0], _MG)}, {_OF('Operating runway', METRICS[1], BENCHMARKS[1], _RG, ' months')}, {_OF('Revenue diversification', METRICS[2], BENCHMARKS[2], _DG)},
      CASE WHEN stress_test_status = 'computed' THEN 'Under a 25% largest-source shock, severity is ' || stress_25pct_severity || coalesce(' with ' || format('{{:.1f}}', stress_25pct_burn_months) || ' months of burn runway', '') || '.' ELSE 'Stress-test scenario unavailable due to missing raw inputs.' END,
      coalesce(e1.org_name || ' (' || e1.state || ') recovered from a similar ' || {_PLAIN} || ' position between ' || e1.y0 || ' and ' || e1.y1 || ', improving ' || e1.metric || ' from ' || format('{{:.2f}}', e1.v0) || ' to ' || format('{{:.2f}}', e1.v1) || '.', 'No recovery analog evidence is available for this organization.'),
      'Recommended action: ' || action_label || '.',
      CASE action_label WHEN 'Needs Data Diligence' THEN 'This is driven by ' || array_to_string(list_transform(string_split(rationale, ','), lambda r: CASE r {_SAID} WHEN '{labels.REVIEW_RULES[3]}' THEN 'resilience gap of ' || {_NA('resilience_gap')} || ' exceeds the structural outlier threshold of 2.0' ELSE r END), '; ') || '.'
        WHEN 'Underinvested Asset Base' THEN 'All three resilience metrics are at or above cohort benchmarks, with no severe stress-test exposure and no urgency flag.'
        WHEN 'Revenue Concentration Risk' THEN 'Revenue diversification gap of ' || {_NA(_DG)} || ' indicates elevated concentration risk, while operating margin remains adequate for targeted diversification.'
        ELSE 'The primary constraint is ' || {_PLAIN} || ', which should be addressed before additional capital deployment.' END,
      CASE WHEN checkpoint1_confidence_tier = 'Low' AND urgency_severity = 'acute' THEN 'Data confidence is insufficient to support a specific action recommendation. The available data suggests potential imminent distress, but current filings should be verified directly before any capital decision.'
        WHEN checkpoint1_confidence_tier = 'Low' THEN 'Data confidence is insufficient to support a specific action recommendation and the row should be reviewed directly before action.'
        WHEN checkpoint1_confidence_tier = 'Medium' THEN 'Data confidence is moderate; additional verification may strengthen this assessment.' WHEN checkpoint1_confidence_tier = 'High' THEN 'Data confidence is high.' END) AS memo_text FROM reasoned""",
    "reasoned",
)


@query("l06_memo_sentences", "SELECT ein, fiscal_year, memo_text FROM sentences", "sentences")
def l06b(spark, d):
    return labels.memo_in_sentences(labelled(spark, d)).select(*KEY, "memo_text")


@query("l07_word_limit", r"SELECT count(*) FILTER (length(regexp_replace(trim(memo_text), '\S+', '', 'g')) + 1 > 250) AS too_long, max(length(regexp_replace(trim(memo_text), '\S+', '', 'g')) + 1) AS longest FROM memos", "memos")
def l07(spark, d):
    n = labels.words(F.col("memo_text"))
    return labelled(spark, d).agg(F.count_if(n > 250).alias("too_long"), F.max(n).cast("long").alias("longest"))


_POS = "CASE WHEN resilience_gap IS NULL THEN 'unavailable' WHEN resilience_gap <= 0 THEN 'at or above peers' ELSE 'below peers' END"
_MIX = "coalesce(largest_revenue_source || ' ' || format('{:.0f}', largest_revenue_source_pct * 100) || '%', 'unavailable')"


@query("l08_contract_views", f"SELECT ein, org_name AS organization_name, cohort_key AS peer_cohort, checkpoint1_confidence_tier, {_POS} AS benchmark_position, round(resilience_gap, 6) AS resilience_gap, {_MIX} AS funding_concentration_profile, action_label, urgency_flag FROM labelled", "labelled")
def l08(spark, d):
    """Reads nothing of the analogs, the trend or the memo, so these are not made."""
    return labels.portfolio_row(labels.label(stages.stressed(tp.panel(spark, d), tp.CONFIG))).withColumn("resilience_gap", F.round("resilience_gap", 6))


@query("l08_memo_view", f"SELECT org_name AS organization_name, cohort_key AS peer_cohort, checkpoint1_confidence_tier AS confidence_level, {_POS} AS benchmark_position_vs_peers, round(resilience_gap, 6) AS resilience_gap, trend_direction AS trend_7_year, coalesce(recovery_analog_constraint, 'none') AS biggest_financial_constraint, {_MIX} AS funding_concentration_profile, round(shock_absorption_months, 6) AS shock_absorption_months, coalesce(stress_25pct_severity, 'unavailable') AS stress_test_scenario, recovery_analog_eins AS recovery_analogs, action_label AS final_recommendation, memo_text AS plain_english_why FROM memos", "memos")
def l08b(spark, d):
    return labels.memo_row(labelled(spark, d)).withColumns({"resilience_gap": F.round("resilience_gap", 6), "shock_absorption_months": F.round("shock_absorption_months", 6)})


