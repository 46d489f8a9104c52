"""Case replay (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import metrics as m
from ledgerline.functions.text import fixed
from ledgerline.operators import analogs, replay
from ledgerline.plans import testpanel as tp
from ledgerline.plans.oracle import add
from ledgerline.plans.reuse import cut
from ledgerline.queries import scoring  # noqa: F401  defines the views pool and matched
from ledgerline.queries.base import DEFICIT, LARGEST, LARGEST_NAME
from ledgerline.queries.risk import test_rows
from ledgerline.registry import query

KEY = ["ein", "fiscal_year"]
r6 = lambda c: F.round(c, 6).alias(c)

add("runways", f"SELECT *, {DEFICIT} AS cash_runway_months, (total_revenue - total_expenses) / nullif(total_revenue, 0) * 100 AS operating_margin_pct, {LARGEST_NAME} AS largest_source_name, {LARGEST} / nullif(total_revenue, 0) * 100 AS largest_pct FROM metrics", "metrics")
add("after_min", "SELECT a.ein, a.fiscal_year, min(b.cash_runway_months) AS t_plus_min_runway, min(b.operating_margin_pct) AS t_plus_min_margin FROM runways a LEFT JOIN runways b ON a.ein = b.ein AND b.fiscal_year BETWEEN a.fiscal_year + 1 AND a.fiscal_year + 2 GROUP BY ALL", "runways")
add("cands", "SELECT * FROM risk WHERE state IN ('AF', 'AM', 'AS') AND net_assets_eoy BETWEEN 1e4 AND 1e8 AND total_revenue BETWEEN 1e4 AND 1e8 AND total_expenses >= 1e4 AND proba > 0.3 AND target = 1 AND shock_absorption_months >= 2 AND operating_margin >= -0.2", "risk")
add("calls", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) AS rn FROM cands) WHERE rn = 1", "cands")


def panel(spark, d):
    return cut(replay.with_runway(m.with_metrics(tp.panel(spark, d))))


def risk(spark, d):
    from ledgerline.operators import features
    from ledgerline.plans import stages
    from ledgerline.queries.risk import measured

    return stages.with_probability(features.target(measured(spark, d))).where("target IS NOT NULL")


def cands(spark, d):
    return replay.candidates(risk(spark, d), ("AF", "AM", "AS"), (1e4, 1e8), (1e4, 1e8), 1e4, 0.3, 2.0, -0.2)


def calls(spark, d):
    return cut(replay.latest_call(cands(spark, d)))


@query("r01_candidates", "SELECT ein, fiscal_year, proba FROM cands", "cands")
def r01(spark, d):
    return cands(spark, d).select(*KEY, "proba")


@query("r02_recognisable", "SELECT ein, fiscal_year FROM panel WHERE NOT regexp_matches(upper(coalesce(org_name, '')), '00011|PENSION') AND ntee_major_category IN ('A', 'B', 'H')", "panel")
def r02(spark, d):
    return replay.recognisable(tp.panel(spark, d), ("00011", "PENSION"), ("A", "B", "H")).select(*KEY)


@query("r03_continuity", "SELECT c.ein, c.fiscal_year FROM cands c JOIN panel p ON p.ein = c.ein AND p.fiscal_year BETWEEN c.fiscal_year - 1 AND c.fiscal_year + 1 GROUP BY ALL HAVING count(*) = 3", "cands", "panel")
def r03(spark, d):
    return replay.continuous(cands(spark, d), tp.panel(spark, d), 1, 1).select(*KEY)


@query("r04_latest_call", "SELECT ein, fiscal_year FROM calls", "calls")
def r04(spark, d):
    return calls(spark, d).select(*KEY)


@query("r05_forward_minimum", "SELECT ein, fiscal_year, round(t_plus_min_runway, 6) AS t_plus_min_runway, round(t_plus_min_margin, 6) AS t_plus_min_margin FROM after_min", "after_min")
def r05(spark, d):
    return replay.after_minimum(panel(spark, d)).select(*KEY, r6("t_plus_min_runway"), r6("t_plus_min_margin"))


add("strong", "SELECT c.*, t_plus_min_runway, t_plus_min_margin, round(proba * 40 + (12 - least(greatest(t_plus_min_runway, 0), 12)) * 3 + least(greatest(shock_absorption_months - t_plus_min_runway, 0), 20) * 1.5, 6) AS demo_strength FROM calls c JOIN after_min USING (ein, fiscal_year)", "calls", "after_min")


def strong(spark, d):
    after = replay.after_minimum(panel(spark, d)).select(*KEY, "t_plus_min_runway", "t_plus_min_margin")
    return replay.strength(calls(spark, d).join(after, KEY))


@query("r06_strength_top", "SELECT ein, fiscal_year, demo_strength FROM strong ORDER BY demo_strength DESC, ein LIMIT 30", "strong")
def r06(spark, d):
    return replay.strongest(strong(spark, d)).select(*KEY, "demo_strength")


@query(
    "r07_trajectories",
    """SELECT c.ein, c.fiscal_year AS call_year, y AS fy, p.ein IS NULL AS missing, round(p.operating_margin_pct, 6) AS margin, round(p.cash_runway_months, 6) AS runway, p.largest_source_name
       FROM (SELECT *, unnest(range(fiscal_year - 2, fiscal_year + 3)) AS y FROM calls) c LEFT JOIN runways p ON p.ein = c.ein AND p.fiscal_year = y""",
    "calls", "runways",
)
def r07(spark, d):
    t = replay.trajectories(calls(spark, d), panel(spark, d)).select("ein", "call_year", F.explode("trajectory").alias("t"))
    return t.select("ein", "call_year", F.col("t.fy").cast("long").alias("fy"), "t.missing", F.round("t.operating_margin_pct", 6).alias("margin"), F.round("t.cash_runway_months", 6).alias("runway"), "t.largest_source_name")


@query(
    "r08_narrative",
    """SELECT ein, state || ', sector ' || ntee_major_category || ': called in FY' || fiscal_year || ' at ' || format('{:.0f}', proba * 100) || '%. ' || CASE WHEN t_plus_min_runway < 3
       THEN 'Least runway after it: ' || format('{:.1f}', t_plus_min_runway) || ' months' || coalesce('; least margin: ' || format('{:.1f}', t_plus_min_margin) || '%.', '.') ELSE 'Urgent a year later.' END AS narrative FROM strong""",
    "strong",
)
def r08(spark, d):
    return strong(spark, d).select("ein", replay.narrative().alias("narrative"))


@query("r09_second_model", "SELECT c.ein, c.fiscal_year, c.proba, t.proba2 FROM calls c LEFT JOIN test t USING (ein, fiscal_year)", "calls", "test")
def r09(spark, d):
    second = test_rows(spark, d).select(*KEY, "proba2")
    return calls(spark, d).select(*KEY, "proba").join(second, KEY, "left")


@query("r10_percentile_rank", "SELECT ein, fiscal_year, round((rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2.0) / count(*) OVER () * 100, 6) AS percentile FROM test", "test")
def r10(spark, d):
    return replay.percentile_rank(test_rows(spark, d)).select(*KEY, "percentile")


_PLUS = lambda x: f"CASE WHEN {x} < 0 THEN '' ELSE '+' END || format('{{:.1f}}', {x})"


@query("r11_outcomes", f"SELECT c.ein, k, 'FY' || p.fiscal_year || ': margin ' || {_PLUS('p.operating_margin_pct')} || '%, runway ' || format('{{:.1f}}', p.cash_runway_months) || 'mo' AS summary FROM calls c JOIN (SELECT unnest([1, 2]) AS k) ON true JOIN runways p ON p.ein = c.ein AND p.fiscal_year = c.fiscal_year + k", "calls", "runways")
def r11(spark, d):
    t = replay.trajectories(calls(spark, d), panel(spark, d)).select("ein", "call_year", F.explode(F.filter("trajectory", lambda x: ~x["missing"])).alias("t"))
    k = F.col("t.fy") - F.col("call_year")
    return t.withColumn("k", k).where("k IN (1, 2)").select("ein", "k", replay.outcome(F.col("t.fy"), F.col("t.operating_margin_pct"), F.col("t.cash_runway_months")).alias("summary"))


_RISK = "least(greatest(18.0 + CASE WHEN margin < 0 THEN 18 WHEN margin < 4 THEN 8 ELSE -5 END + CASE WHEN cushion < 3 THEN 20 WHEN cushion < 6 THEN 9 ELSE -4 END + CASE WHEN diversity < 0.25 THEN 12 WHEN diversity < 0.45 THEN 5 ELSE -3 END, 2), 95)"


@query(
    "r12_replay_window",
    f"""SELECT ein, fiscal_year, "offset", round(margin, 6) AS margin, round(cushion, 6) AS cushion, round(diversity, 6) AS diversity, round({_RISK}, 6) AS risk FROM (
      SELECT p.ein, p.fiscal_year, CAST(p.place - c.place AS INTEGER) AS "offset", p.operating_margin * 100 AS margin, greatest(0, p.shock_absorption_months) AS cushion, coalesce(p.revenue_diversification_index, 0) AS diversity
      FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year) AS place FROM metrics) p JOIN (SELECT m.ein, place FROM (SELECT ein, fiscal_year, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year) AS place FROM metrics) m JOIN calls USING (ein, fiscal_year)) c ON p.ein = c.ein) WHERE abs("offset") <= 2""",
    "metrics", "calls",
)
def r12(spark, d):
    return replay.states_around(panel(spark, d), calls(spark, d), 18.0)


_F = lambda x, k=0: f"format('{{:.{k}f}}', {x})"
_SIGNALS = f"""list_filter([CASE WHEN largest_pct >= 90 THEN 'nearly one source: ' || {_F('largest_pct')} || '%' WHEN largest_pct >= 70 THEN 'main source: ' || {_F('largest_pct')} || '%' END,
  CASE WHEN gap1 < -0.15 THEN 'mix ' || {_F('abs(gap1)', 2)} || ' under peers' END,
  CASE WHEN margin < 0 THEN 'deficit: ' || {_F('margin', 1)} || '%' WHEN margin < 5 THEN 'slim surplus: ' || {_F('margin', 1)} || '%' END,
  CASE WHEN slope < -2 THEN 'margin loses ' || {_F('abs(slope)', 1)} || ' points a year' END,
  CASE WHEN eg - rg > 0.08 THEN 'growth of expenses ' || {_F('eg * 100')} || '%, of revenue ' || {_F('rg * 100')} || '%' END,
  CASE WHEN shock_absorption_months < 6 THEN 'reserves under 6 months' WHEN shock_absorption_months < 12 AND largest_pct >= 70 THEN 'reserves too thin for the main source' END], lambda x: x IS NOT NULL)"""


@query(
    "r13_early_warnings",
    f"""SELECT ein, fiscal_year, array_to_string(({_SIGNALS})[1:3], ' ') AS signals FROM (SELECT *, revenue_diversification_index - 0.6 AS gap1, operating_margin * 100 AS margin, (operating_margin - lag(operating_margin, 2) OVER w) / 2 * 100 AS slope,
       total_revenue / nullif(lag(total_revenue) OVER w, 0) - 1 AS rg, total_expenses / nullif(lag(total_expenses) OVER w, 0) - 1 AS eg FROM runways WINDOW w AS (PARTITION BY ein ORDER BY fiscal_year))""",
    "runways",
)
def r13(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ein").orderBy("fiscal_year")
    g = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    df = panel(spark, d).withColumns({"largest_pct": F.col("largest_source_pct"), "revenue_diversification_gap": F.col("revenue_diversification_index") - 0.6, "margin": F.col("operating_margin") * 100, "margin_slope": (F.col("operating_margin") - F.lag("operating_margin", 2).over(w)) / 2 * 100, "revenue_growth": g("total_revenue"), "expense_growth": g("total_expenses"), "cushion": F.col("shock_absorption_months")})
    none = {"operating_runway_gap": F.lit(None).cast("double"), "trend_direction": F.lit("unavailable"), "checkpoint1_confidence_tier": F.lit("High")}
    return df.withColumns(none).select(*KEY, F.array_join(replay.warnings(), " ").alias("signals"))


add("safety_long", "SELECT ein, fiscal_year, 'revenue_diversification_index' AS metric, revenue_diversification_index AS value, 0.45 AS line FROM metrics UNION ALL SELECT ein, fiscal_year, 'operating_runway_proxy_months', operating_runway_proxy_months, 6.0 FROM metrics UNION ALL SELECT ein, fiscal_year, 'operating_margin', operating_margin, 0.0 FROM metrics", "metrics")
add("safety", "SELECT ein, metric, below_year, min(fiscal_year) FILTER (value >= line AND fiscal_year > below_year) AS safe_year FROM (SELECT *, min(fiscal_year) FILTER (value < line) OVER (PARTITION BY ein, metric) AS below_year FROM safety_long) WHERE below_year IS NOT NULL GROUP BY ALL", "safety_long")


@query("r14_time_to_safety", "SELECT ein, metric, below_year, safe_year, safe_year - below_year AS years_taken FROM safety", "safety")
def r14(spark, d):
    return replay.time_to_safety(panel(spark, d))


add("peer_pairs", "SELECT a.peer AS target, b.peer, a.metric, abs(b.peer_revenue / a.peer_revenue - 1) AS distance, b.post_year - b.pre_year AS years, b.post_value - b.pre_value AS gain FROM pool a JOIN pool b ON a.metric = b.metric AND a.metric = 'operating_margin' AND a.size_bucket = b.size_bucket AND a.peer_state = b.peer_state AND a.peer_sector = b.peer_sector AND a.peer <> b.peer", "pool")


@query(
    "r15_three_peers",
    """WITH c AS (SELECT target, peer FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, peer) AS r FROM peer_pairs) WHERE r = 1),
       f AS (SELECT target, peer FROM (SELECT p.*, row_number() OVER (PARTITION BY p.target ORDER BY years, p.peer) AS r FROM peer_pairs p ANTI JOIN c ON c.target = p.target AND c.peer = p.peer) WHERE r = 1),
       s AS (SELECT target, peer FROM (SELECT p.*, row_number() OVER (PARTITION BY p.target ORDER BY gain DESC, p.peer) AS r FROM peer_pairs p ANTI JOIN c ON c.target = p.target AND c.peer = p.peer ANTI JOIN f ON f.target = p.target AND f.peer = p.peer) WHERE r = 1)
       SELECT *, 'closest' AS role FROM c UNION ALL SELECT *, 'fastest' FROM f UNION ALL SELECT *, 'strongest' FROM s""".replace("WITH c AS", "SELECT * FROM (WITH c AS") + ")",
    "peer_pairs",
)
def r15(spark, d):
    pool = cut(analogs.pool(m.with_metrics(tp.panel(spark, d))).where("metric = 'operating_margin'"))
    return replay.three_peers(cut(replay.peer_candidates(pool, ["size_bucket", "peer_state", "peer_sector"])))


@query(
    "r16_recovery_story",
    """SELECT p.peer, p.metric, p.peer_name || ' moved ' || replace(p.metric, '_', ' ') || ' from ' || format('{:.2f}', pre_value) || ' to ' || format('{:.2f}', post_value) || ' over ' || pre_year || '-' || post_year || CASE WHEN s.safe_year IS NOT NULL THEN ', crossing the safety line by ' || s.safe_year || '.' ELSE ', not yet past the safety line.' END AS story
       FROM pool p LEFT JOIN safety s ON s.ein = p.peer AND s.metric = p.metric""",
    "pool", "safety",
)
def r16(spark, d):
    p = m.with_metrics(tp.panel(spark, d))
    safe = replay.time_to_safety(p).select(F.col("ein").alias("peer"), "metric", "safe_year")
    pool = analogs.pool(p).join(safe, ["peer", "metric"], "left")
    end = F.when(F.col("safe_year").isNotNull(), F.concat(F.lit(", crossing the safety line by "), F.col("safe_year").cast("string"), F.lit("."))).otherwise(", not yet past the safety line.")
    story = F.concat("peer_name", F.lit(" moved "), F.replace("metric", F.lit("_"), F.lit(" ")), F.lit(" from "), fixed(F.col("pre_value"), 2), F.lit(" to "), fixed(F.col("post_value"), 2), F.lit(" over "), F.col("pre_year").cast("string"), F.lit("-"), F.col("post_year").cast("string"), end)
    return pool.select("peer", "metric", story.alias("story"))
