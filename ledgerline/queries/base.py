"""Cleaning (C), keyed merges (U), profiles (Q) and row metrics (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.config import DEFAULT, STREAMS
from ledgerline.functions import metrics as m
from ledgerline.functions import text as t
from ledgerline.operators import clean, merge, profile
from ledgerline.plans import testpanel as tp
from ledgerline.plans.oracle import add
from ledgerline.plans.reuse import cut, scratch
from ledgerline.registry import query
from ledgerline.sources import versions

r6 = lambda x: F.round(x, 6)


@query(
    "entry",
    "SELECT ein, fiscal_year, round(operating_margin, 6) AS operating_margin, round(operating_runway_proxy_months, 6) AS runway_months, round(revenue_diversification_index, 6) AS diversification FROM metrics",
    "metrics",
)
def entry(spark, d):
    return m.with_metrics(merge.latest_filing(tp.panel(spark, d))).select(
        "ein", "fiscal_year", r6("operating_margin").alias("operating_margin"), r6("operating_runway_proxy_months").alias("runway_months"), r6("revenue_diversification_index").alias("diversification")
    )


# --- cleaning -------------------------------------------------------------------------------------------------------


@query("c01_rename", "SELECT c_custkey AS ein, c_name AS org_name, c_mktsegment AS sector, c_acctbal AS balance FROM customer")
def c01(spark, d):
    return clean.rename(tp.table(spark, d, "customer").drop("c_nationkey"), {"c_custkey": "ein", "c_name": "org_name", "c_mktsegment": "sector", "c_acctbal": "balance"})


@query("c02_coerce", "SELECT c_custkey, TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS balance, TRY_CAST(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS INTEGER) AS nation FROM customer")
def c02(spark, d):
    raw = tp.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("balance"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("nation"))
    return clean.coerce(raw, ["balance"], ["nation"])


@query("c03_filters", "SELECT ein, fiscal_year, state FROM panel WHERE return_type = '990' AND state IN ('AF', 'EU') AND ntee_major_category IS NOT NULL", "panel")
def c03(spark, d):
    return clean.keep(tp.panel(spark, d), "990", ["AF", "EU"], ["ein", "fiscal_year", "ntee_major_category"]).select("ein", "fiscal_year", "state")


@query("c04_name_assembly", "SELECT p_partkey, nullif(trim(coalesce(nullif(p_name, 'red widget'), '') || ' ' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END), '') AS org_name FROM part")
def c04(spark, d):
    return tp.table(spark, d, "part").select("p_partkey", t.joined_name(F.nullif(F.col("p_name"), F.lit("red widget")), F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("org_name"))


@query(
    "c05_city_repair",
    """SELECT n_nationkey, CASE WHEN length(city) > 3 AND length(city) % 2 = 0 AND left(city, length(city) // 2) = right(city, length(city) // 2) THEN left(city, length(city) // 2)
       WHEN ends_with(city, state || state) THEN left(city, length(city) - length(state)) ELSE city END AS city
       FROM (SELECT n_nationkey, right(n_name, 2) AS state, CASE n_nationkey % 3 WHEN 0 THEN n_name || n_name WHEN 1 THEN n_name || right(n_name, 2) || right(n_name, 2) ELSE n_name END AS city FROM nation)""",
)
def c05(spark, d):
    n = tp.table(spark, d, "nation").withColumn("state", F.right("n_name", F.lit(2)))
    k = F.col("n_nationkey") % 3
    city = F.when(k == 0, F.concat("n_name", "n_name")).when(k == 1, F.concat("n_name", "state", "state")).otherwise(F.col("n_name"))
    return n.withColumn("city", city).select("n_nationkey", t.repaired_city(F.col("city"), F.col("state")).alias("city"))


@query("c06_collapse_text", r"SELECT doc_id, nullif(left(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), 500), '') AS mission FROM documents")
def c06(spark, d):
    return tp.table(spark, d, "documents").select("doc_id", t.collapsed(F.col("text")).alias("mission"))


@query("c07_first_present", "SELECT ein, fiscal_year, coalesce(cash_non_interest_bearing, savings_temporary_investments) AS first_cash, coalesce(nullif(savings_temporary_investments, 0), other_revenue) AS nonzero FROM panel", "panel")
def c07(spark, d):
    return tp.panel(spark, d).select("ein", "fiscal_year", clean.first_present(F.col("cash_non_interest_bearing"), F.col("savings_temporary_investments")).alias("first_cash"), clean.first_present(F.col("savings_temporary_investments"), F.col("other_revenue"), zero_is_missing=True).alias("nonzero"))


@query("c08_fiscal_year", "SELECT o_orderkey, TRY_CAST(left(CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END, 4) AS INTEGER) AS fiscal_year FROM orders")
def c08(spark, d):
    p = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tp.table(spark, d, "orders").select("o_orderkey", clean.year_of(p).alias("fiscal_year"))


@query("c09_normalise", "SELECT filing_id, trim(' ' || ein || ' ') AS ein, upper(trim(' ' || lower(state))) AS state, coalesce(trim(ntee_major_category), '') AS ntee_major_category, coalesce(submitted_on, '') AS submitted_on FROM spine", "spine")
def c09(spark, d):
    raw = tp.spine(spark, d).withColumns({"ein": F.concat(F.lit(" "), "ein", F.lit(" ")), "state": F.concat(F.lit(" "), F.lower("state"))})
    return clean.normalise(raw).select("filing_id", "ein", "state", "ntee_major_category", "submitted_on")


@query("c10_residual", "SELECT ein, fiscal_year, round(total_revenue - coalesce(contributions_grants, 0) - coalesce(program_service_revenue, 0) - coalesce(investment_income, 0), 4) + 0.0 AS residual, round(coalesce(other_revenue, total_revenue - coalesce(contributions_grants, 0) - coalesce(program_service_revenue, 0) - coalesce(investment_income, 0)), 4) + 0.0 AS filled FROM panel", "panel")
def c10(spark, d):
    df = tp.panel(spark, d).withColumn("filled", F.col("other_revenue"))
    df = clean.fill_residual(df, "filled", "total_revenue", *STREAMS[:3])
    return df.select("ein", "fiscal_year", (F.round(clean.residual(F.col("total_revenue"), *map(F.col, STREAMS[:3])), 4) + 0.0).alias("residual"), (F.round("filled", 4) + 0.0).alias("filled"))


@query("c11_shares", "SELECT ein, fiscal_year, round(pct_contributions, 6) AS a, round(pct_program_revenue, 6) AS b, round(pct_investment_income, 6) AS c, round(pct_other_revenue, 6) AS d FROM panel", "panel")
def c11(spark, d):
    df = clean.shares(tp.panel(spark, d))
    return df.select("ein", "fiscal_year", r6("pct_contributions").alias("a"), r6("pct_program_revenue").alias("b"), r6("pct_investment_income").alias("c"), r6("pct_other_revenue").alias("d"))


@query("c12_caps", "SELECT p_partkey, CASE WHEN p_size * 100 BETWEEN 1700 AND 2026 THEN p_size * 100 END AS formation_year, CASE WHEN p_size > 2 THEN least(p_size * 10000, 200000) END AS num_employees, least(p_size * 20, 500) AS num_voting_board_members FROM part")
def c12(spark, d):
    df = tp.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("formation_year"), F.when(F.col("p_size") > 2, F.col("p_size") * 10000).alias("num_employees"), (F.col("p_size") * 20).alias("num_voting_board_members"))
    return clean.caps(df)


@query("c13_size_bucket", "SELECT ein, fiscal_year, size_bucket, CASE WHEN total_revenue IS NULL THEN 'unknown' ELSE coalesce(size_bucket, '<500K') END AS model_bucket FROM bucketed", "bucketed")
def c13(spark, d):
    x = F.col("total_revenue")
    return tp.panel(spark, d).select("ein", "fiscal_year", m.size_bucket(x).alias("size_bucket"), m.size_bucket(x, "band", "unknown").alias("model_bucket"))


@query("c14_eligibility", "SELECT ein, fiscal_year, scoring_eligible, is_scoring_year FROM eligible", "eligible")
def c14(spark, d):
    return m.with_eligibility(m.with_metrics(tp.panel(spark, d))).select("ein", "fiscal_year", "scoring_eligible", "is_scoring_year")


@query("c15_align_union", "SELECT filing_id, ein, total_revenue, submitted_on FROM spine UNION ALL SELECT filing_id, ein, total_revenue, NULL FROM feed", "spine", "feed")
def c15(spark, d):
    first = tp.spine(spark, d).select("filing_id", "ein", "total_revenue", "submitted_on")
    return clean.union_aligned(first, tp.feed(spark, d).select("ein", "state", "total_revenue", "filing_id"))


@query(
    "c16_vocabulary",
    """SELECT o_orderkey, CASE old WHEN 'Amplify' THEN 'Underinvested Asset Base' WHEN 'Deep Review' THEN 'Needs Data Diligence' WHEN 'Diversify' THEN 'Revenue Concentration Risk' ELSE old END AS label,
       replace(replace(replace('Plan: ' || old || ' now.', 'Deep Review', 'Needs Data Diligence'), 'Amplify', 'Underinvested Asset Base'), 'Diversify', 'Revenue Concentration Risk') AS memo
       FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Amplify' WHEN 1 THEN 'Deep Review' WHEN 2 THEN 'Diversify' ELSE 'Weak Financial Foundation' END AS old FROM orders)""",
)
def c16(spark, d):
    k = F.col("o_orderkey") % 4
    df = tp.table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "Amplify").when(k == 1, "Deep Review").when(k == 2, "Diversify").otherwise("Weak Financial Foundation").alias("old"))
    return df.select("o_orderkey", clean.current_label(F.col("old")).alias("label"), clean.current_wording(F.concat(F.lit("Plan: "), "old", F.lit(" now."))).alias("memo"))


@query("c17_title_case", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'The ' ELSE 'Friends of the ' END || upper(left(split_part(p_name, ' ', 1), 1)) || substr(split_part(p_name, ' ', 1), 2) || ' YM ' || upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) || '-Fund III' AS name FROM part")
def c17(spark, d):
    raw = F.concat(F.when(F.col("p_size") % 2 == 0, "THE ").otherwise("FRIENDS OF THE "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" YM "), F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("-FUND III"))
    return tp.table(spark, d, "part").select("p_partkey", t.title_case(raw).alias("name"))


@query(
    "c18_formatting",
    """SELECT o_orderkey, CASE WHEN v >= 1e6 THEN '$' || format('{:.1f}', v / 1e6) || 'M' WHEN v >= 1e3 THEN '$' || format('{:.0f}', v / 1e3) || 'K' ELSE '$' || format('{:.0f}', v) END AS compact,
       CASE WHEN v < 1000 THEN 'Unavailable' ELSE '$' || format('{:,.0f}', v) END AS currency, format('{:.1f}', v / 1e6 * 100) || '%' AS pct, CASE WHEN v - 200000 < 0 THEN '' ELSE '+' END || format('{:.2f}', (v - 200000) / 1e5) AS delta
       FROM (SELECT o_orderkey, o_totalprice AS v FROM orders)""",
)
def c18(spark, d):
    v = F.col("o_totalprice")
    return tp.table(spark, d, "orders").select("o_orderkey", t.compact_currency(v).alias("compact"), t.currency(v).alias("currency"), t.percent(v / 1e6).alias("pct"), t.signed((v - 200000) / 1e5).alias("delta"))


# --- keyed merges ---------------------------------------------------------------------------------------------------

add("latest", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ein, fiscal_year ORDER BY tax_period_end DESC NULLS LAST, filing_id) AS rn FROM filings) WHERE rn = 1", "filings")
KEY = ["ein", "tax_period_end"]
add("spine1", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ein, tax_period_end ORDER BY filing_id) AS rn FROM spine) WHERE rn = 1", "spine")
add("feed1", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ein, tax_period_end ORDER BY filing_id) AS rn FROM feed) WHERE rn = 1", "feed")
add("upserted", "SELECT * FROM spine1 s WHERE NOT EXISTS (SELECT 1 FROM feed1 f WHERE f.ein = s.ein AND f.tax_period_end = s.tax_period_end) UNION ALL SELECT * FROM feed1", "spine1", "feed1")


def spine1(spark, d):
    return merge.first_of(tp.spine(spark, d), KEY, F.asc("filing_id"))


def feed1(spark, d):
    return merge.first_of(tp.feed(spark, d), KEY, F.asc("filing_id"))


@query("u01_dedupe_first", "SELECT filing_id, ein, tax_period_end FROM spine1", "spine1")
def u01(spark, d):
    return spine1(spark, d).select("filing_id", *KEY)


@query("u02_latest_filing", "SELECT filing_id, ein, fiscal_year FROM latest", "latest")
def u02(spark, d):
    return merge.latest_filing(tp.filings(spark, d), DEFAULT, F.asc("filing_id")).select("filing_id", "ein", "fiscal_year")


@query(
    "u03_latest_complete",
    """SELECT filing_id, ein, fiscal_year FROM (SELECT *, row_number() OVER (PARTITION BY ein, fiscal_year ORDER BY tax_period_end DESC NULLS LAST,
       CAST(contributions_grants IS NULL AS INT) + CAST(program_service_revenue IS NULL AS INT) + CAST(cash_non_interest_bearing IS NULL AS INT), filing_id) AS rn FROM filings) WHERE rn = 1""",
    "filings",
)
def u03(spark, d):
    fewest = merge.fewest_nulls(["contributions_grants", "program_service_revenue", "cash_non_interest_bearing"])
    return merge.latest_filing(tp.filings(spark, d), DEFAULT, fewest.asc(), F.asc("filing_id")).select("filing_id", "ein", "fiscal_year")


@query("u04_latest_row", "SELECT filing_id, ein, fiscal_year FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC, tax_period_end DESC, filing_id) AS rn FROM filings) WHERE rn = 1", "filings")
def u04(spark, d):
    return merge.latest_row(tp.filings(spark, d), DEFAULT, F.asc("filing_id")).select("filing_id", "ein", "fiscal_year")


@query("u05_upsert", "SELECT filing_id, ein, tax_period_end, total_revenue, submitted_on FROM upserted", "upserted")
def u05(spark, d):
    return merge.upsert(spine1(spark, d), feed1(spark, d), KEY).select("filing_id", *KEY, "total_revenue", "submitted_on")


add("batch", "SELECT * REPLACE (round(total_revenue * 2, 2) AS total_revenue, '2003-01-01' AS submitted_on) FROM feed1 WHERE filing_id % 15 = 0", "feed1")
add(
    "merged",
    """SELECT * FROM upserted WHERE submitted_on IS NULL
    UNION ALL SELECT * FROM upserted u WHERE submitted_on IS NOT NULL AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.ein = u.ein AND b.tax_period_end = u.tax_period_end)
    UNION ALL SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM upserted u WHERE u.submitted_on IS NULL AND b.ein = u.ein AND b.tax_period_end = u.tax_period_end)""",
    "upserted",
    "batch",
)


def batch(feed, n=15):
    return feed.where(F.col("filing_id") % n == 0).withColumns({"total_revenue": F.round(F.col("total_revenue") * 2, 2), "submitted_on": F.lit("2003-01-01")})


@query("u06_merge_by_source", "SELECT filing_id, ein, tax_period_end, total_revenue, submitted_on FROM merged", "merged")
def u06(spark, d):
    feed = cut(feed1(spark, d))
    current = merge.upsert(spine1(spark, d), feed, KEY)
    return merge.merge_by_source(current, batch(feed), KEY, F.col("submitted_on").isNotNull()).select("filing_id", *KEY, "total_revenue", "submitted_on")


@query(
    "u07_backfill",
    """SELECT u.filing_id, CASE WHEN u.submitted_on IS NOT NULL AND u.cash_non_interest_bearing IS NULL AND l.filing_id IS NOT NULL THEN l.cash_non_interest_bearing ELSE u.cash_non_interest_bearing END AS cash_non_interest_bearing
       FROM upserted u LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ein, tax_period_end ORDER BY filing_id DESC) AS rn FROM filings) WHERE rn = 1) l ON u.ein = l.ein AND u.tax_period_end = l.tax_period_end""",
    "upserted",
    "filings",
)
def u07(spark, d):
    current = merge.upsert(spine1(spark, d), feed1(spark, d), KEY)
    where = F.col("submitted_on").isNotNull() & F.col("cash_non_interest_bearing").isNull()
    return merge.backfill(current, tp.filings(spark, d), KEY, ["cash_non_interest_bearing"], where, F.desc("filing_id")).select("filing_id", "cash_non_interest_bearing")


@query(
    "u08_overlap_audit",
    """SELECT count(*) FILTER (s.ein IS NOT NULL AND f.ein IS NOT NULL) AS overlap_keys, count(*) FILTER (s.ein IS NULL) AS new_keys, count(*) FILTER (f.ein IS NULL) AS spine_only_keys,
       count(*) FILTER (s.ein IS NOT NULL AND f.ein IS NOT NULL AND (s.total_revenue IS DISTINCT FROM f.total_revenue OR s.total_expenses IS DISTINCT FROM f.total_expenses)) AS changed_keys,
       round(count(*) FILTER (s.ein IS NOT NULL AND f.ein IS NOT NULL AND (s.total_revenue IS DISTINCT FROM f.total_revenue OR s.total_expenses IS DISTINCT FROM f.total_expenses)) / nullif(count(*) FILTER (s.ein IS NOT NULL AND f.ein IS NOT NULL), 0), 6) AS changed_rate
       FROM spine1 s FULL JOIN feed1 f ON s.ein = f.ein AND s.tax_period_end = f.tax_period_end""",
    "spine1",
    "feed1",
)
def u08(spark, d):
    return merge.overlap(spine1(spark, d), feed1(spark, d), KEY, ["total_revenue", "total_expenses"])


@query(
    "u09_reconcile",
    """SELECT field, count(*) AS compared, count(*) FILTER (l = r) AS matched, round(count(*) FILTER (l = r) / count(*), 6) AS rate, count(*) FILTER (l = r) / count(*) >= 0.99 AS passed FROM (
       SELECT unnest(['total_revenue', 'total_expenses', 'cash_non_interest_bearing']) AS field, unnest([s.total_revenue, s.total_expenses, s.cash_non_interest_bearing]) AS l, unnest([f.total_revenue, f.total_expenses, f.net_assets_eoy * 0 + f.savings_temporary_investments]) AS r
       FROM spine1 s JOIN feed1 f ON s.ein = f.ein AND s.tax_period_end = f.tax_period_end) WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY field""",
    "spine1",
    "feed1",
)
def u09(spark, d):
    right = feed1(spark, d).withColumn("cash_non_interest_bearing", F.col("net_assets_eoy") * 0 + F.col("savings_temporary_investments"))
    return merge.reconcile(spine1(spark, d), right, KEY, ["total_revenue", "total_expenses", "cash_non_interest_bearing"])


@query(
    "u09_mismatches",
    """SELECT ein, tax_period_end, field, l, r, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY ein, tax_period_end) AS place FROM (
       SELECT s.ein, s.tax_period_end, unnest(['total_revenue', 'net_assets_eoy']) AS field, unnest([s.total_revenue, s.net_assets_eoy]) AS l, unnest([f.total_revenue, f.net_assets_eoy]) AS r
       FROM spine1 s JOIN feed1 f ON s.ein = f.ein AND s.tax_period_end = f.tax_period_end) WHERE l <> r) WHERE place <= 5""",
    "spine1",
    "feed1",
)
def u09b(spark, d):
    return merge.mismatches(spine1(spark, d), feed1(spark, d), KEY, ["total_revenue", "net_assets_eoy"])


@query("u10_registry_enrichment", "SELECT p.ein, p.fiscal_year, sector, CASE sector WHEN 'B' THEN 'Buildings' WHEN 'M' THEN 'Machines' WHEN 'H' THEN 'Homes' END AS sector_name FROM panel p LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS ein, upper(left(trim(lower(c_mktsegment)), 1)) AS sector FROM customer WHERE c_custkey % 3 <> 0) c ON p.ein = c.ein", "panel")
def u10(spark, d):
    registry = tp.table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("ein"), F.lower("c_mktsegment").alias("code"))
    names = spark.createDataFrame([("B", "Buildings"), ("M", "Machines"), ("H", "Homes")], "sector string, sector_name string")
    return merge.enrich(tp.panel(spark, d), registry, "ein", "code", names).select("ein", "fiscal_year", "sector", "sector_name")


@query("u10_match_rate", "SELECT count(*) AS entities, CAST(sum(CAST(c_custkey % 3 <> 0 AS INT)) AS BIGINT) AS matched, round(avg(CAST(c_custkey % 3 <> 0 AS INT)), 6) AS rate FROM (SELECT DISTINCT CAST(ein AS INTEGER) AS c_custkey FROM panel)", "panel")
def u10b(spark, d):
    return merge.match_rate(u10(spark, d), "ein")


@query("u11_hydrate", "SELECT o.ein, o.fiscal_year, p.org_name, p.total_revenue FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS ein, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders) o LEFT JOIN panel p ON o.ein = p.ein AND o.fiscal_year = p.fiscal_year", "panel")
def u11(spark, d):
    keys = tp.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("ein"), F.year("o_orderdate").alias("fiscal_year")).distinct()
    return merge.hydrate(keys, tp.panel(spark, d), ["ein", "fiscal_year"], ["org_name", "total_revenue"])


add("batch2", "SELECT * REPLACE (round(total_revenue * 2, 2) AS total_revenue, '2003-01-01' AS submitted_on) FROM feed1 WHERE filing_id % 35 = 0", "feed1")


@query(
    "u12_incremental_batches",
    """SELECT filing_id, total_revenue, submitted_on FROM merged WHERE submitted_on IS NULL
    UNION ALL SELECT filing_id, total_revenue, submitted_on FROM merged u WHERE submitted_on IS NOT NULL AND NOT EXISTS (SELECT 1 FROM batch2 b WHERE b.ein = u.ein AND b.tax_period_end = u.tax_period_end)
    UNION ALL SELECT filing_id, total_revenue, submitted_on FROM batch2 b WHERE NOT EXISTS (SELECT 1 FROM merged u WHERE u.submitted_on IS NULL AND b.ein = u.ein AND b.tax_period_end = u.tax_period_end)""",
    "merged",
    "batch2",
)
def u12(spark, d):
    """Two batches, the first of them delivered twice, into a table of versions. Filings of the two sources lie in partitions
    of their own, so a batch rewrites only those of the feed."""
    path, feed = scratch(spark), cut(feed1(spark, d))
    placed = lambda df: df.withColumn("part", F.concat_ws("-", "fiscal_year", F.when(F.col("submitted_on").isNull(), "own").otherwise("fed")))
    versions.create(path, placed(merge.upsert(spine1(spark, d), feed, KEY)), "part")
    for name, n in (("2003-01", 15), ("2003-02", 35), ("2003-01", 15)):
        versions.ingest(path, placed(batch(feed, n)), name, KEY, F.col("submitted_on").isNotNull())
    return versions.read(spark, path).select("filing_id", "total_revenue", "submitted_on")


# --- profiles -------------------------------------------------------------------------------------------------------

_NULLS = ["ntee_major_category", "cash_non_interest_bearing", *STREAMS]


@query("q01_null_profile", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS nulls, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM panel" for c in _NULLS) + ")", "panel")
def q01(spark, d):
    return profile.nulls(tp.panel(spark, d), _NULLS)


@query("q02_history_depth", "SELECT round(avg(n), 6) AS mean_rows, median(n) AS median_rows, min(n) AS min_rows, max(n) AS max_rows, count(*) AS entities FROM (SELECT ein, count(*) AS n FROM panel GROUP BY ein)", "panel")
def q02(spark, d):
    return profile.history_depth(tp.panel(spark, d))


@query("q02_history_histogram", "SELECT n AS rows, count(*) AS entities FROM (SELECT ein, count(*) AS n FROM panel GROUP BY ein) GROUP BY n", "panel")
def q02b(spark, d):
    return profile.history_histogram(tp.panel(spark, d))


@query("q03_coverage", "SELECT fiscal_year, count(DISTINCT ein) AS entities, round(avg(CAST(cash_non_interest_bearing IS NOT NULL AS DOUBLE)), 6) AS has_cash_non_interest_bearing FROM panel WHERE state IN ('AF', 'AM') GROUP BY fiscal_year", "panel")
def q03(spark, d):
    return profile.coverage(tp.panel(spark, d), ["AF", "AM"], ["cash_non_interest_bearing"])


@query("q04_coverage_delta", "SELECT fiscal_year, coalesce(b, 0) AS before, coalesce(a, 0) AS after, coalesce(a, 0) - coalesce(b, 0) AS delta FROM (SELECT fiscal_year, count(*) AS b FROM spine GROUP BY 1) FULL JOIN (SELECT fiscal_year, count(*) AS a FROM upserted GROUP BY 1) USING (fiscal_year)", "spine", "upserted")
def q04(spark, d):
    return profile.coverage_delta(tp.spine(spark, d), merge.upsert(spine1(spark, d), feed1(spark, d), KEY))


@query(
    "q05_contract_checks",
    """SELECT 'null_key' AS "check", count(*) FILTER (ein IS NULL OR fiscal_year IS NULL) AS violations FROM metrics UNION ALL SELECT 'year_range', count(*) FILTER (fiscal_year NOT BETWEEN 1996 AND 2000) FROM metrics
       UNION ALL SELECT 'margin_above_one', count(*) FILTER (operating_margin > 1) FROM metrics UNION ALL SELECT 'diversification_range', count(*) FILTER (revenue_diversification_index NOT BETWEEN 0 AND 1) FROM metrics UNION ALL SELECT 'no_cash', count(*) FILTER (cash_non_interest_bearing IS NULL) FROM metrics""",
    "metrics",
)
def q05(spark, d):
    x = F.col
    checks = {
        "null_key": x("ein").isNull() | x("fiscal_year").isNull(),
        "year_range": ~x("fiscal_year").between(1996, 2000),
        "margin_above_one": x("operating_margin") > 1,
        "diversification_range": ~x("revenue_diversification_index").between(0, 1),
        "no_cash": x("cash_non_interest_bearing").isNull(),
    }
    return profile.violations(m.with_metrics(tp.panel(spark, d)), checks)


add("kept", "SELECT * FROM metrics WHERE ein NOT LIKE '%7'", "metrics")


@query(
    "q05_output_contract",
    """SELECT 'null_key' AS "check", count(*) FILTER (ein IS NULL OR fiscal_year IS NULL) AS violations FROM kept UNION ALL SELECT 'not_finite', count(*) FILTER (fiscal_year = 1997 OR coalesce(isnan(operating_margin), false)) FROM kept
       UNION ALL SELECT 'partly_null', count(*) FILTER ((pct_contributions IS NULL OR pct_other_revenue IS NULL) AND NOT (pct_contributions IS NULL AND pct_other_revenue IS NULL)) FROM kept
       UNION ALL SELECT 'range_operating_margin', count(*) FILTER (operating_margin NOT BETWEEN -0.1 AND 0.1) FROM kept UNION ALL SELECT 'range_revenue_diversification_index', count(*) FILTER (revenue_diversification_index NOT BETWEEN 0.1 AND 0.7) FROM kept
       UNION ALL SELECT 'missing_columns', 2 UNION ALL SELECT 'row_count', (SELECT count(*) FROM panel) - (SELECT count(*) FROM kept) UNION ALL SELECT 'keys_lost', (SELECT count(*) FROM panel WHERE ein LIKE '%7') UNION ALL SELECT 'keys_added', (SELECT count(*) FROM kept WHERE ein NOT IN (SELECT ein FROM panel))""",
    "kept", "panel",
)
def q05b(spark, d):
    source = tp.panel(spark, d)
    out = m.with_metrics(source).where("ein NOT LIKE '%7'").withColumn("ratio", F.when(F.col("fiscal_year") == 1997, F.lit(float("-inf"))).otherwise(F.lit(1.0)))
    need = ["ein", "fiscal_year", "operating_margin", "grade", "reviewer"]
    return profile.contract(out, need, ["ratio", "operating_margin"], ["pct_contributions", "pct_other_revenue"], {"operating_margin": (-0.1, 0.1), "revenue_diversification_index": (0.1, 0.7)}, source, ["ein", "fiscal_year"])


@query("q06_distribution", "SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM panel GROUP BY state", "panel")
def q06(spark, d):
    return profile.distribution(tp.panel(spark, d), "state")


add("strata", "SELECT *, row_number() OVER (PARTITION BY state, has_sector ORDER BY total_revenue, ein) - 1 AS place, count(*) OVER (PARTITION BY state, has_sector) AS n FROM (SELECT *, ntee_major_category IS NOT NULL AS has_sector FROM (SELECT *, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) AS rn FROM panel) WHERE rn = 1 AND state IN ('AF', 'EU'))", "panel")
add("strata_places", "SELECT *, CASE WHEN p2 <> p1 THEN p2 WHEN p1 < n - 1 THEN p1 + 1 WHEN p1 > 0 THEN p1 - 1 END AS p3 FROM (SELECT *, CAST(floor(0.33 * n) AS INT) AS p1, CAST(floor(0.66 * n) AS INT) AS p2 FROM strata)", "strata")
add("strata_picks", "SELECT state, has_sector, ein, total_revenue, CAST(place <> p1 AS INT) AS turn FROM strata_places WHERE place = p1 OR place = p3", "strata_places")


@query(
    "q07_quantile_sample",
    """SELECT state, sample_has_sector, ein, total_revenue FROM (SELECT *, row_number() OVER (PARTITION BY state, sample_has_sector ORDER BY lent, turn) AS pick FROM (
         SELECT *, has_sector AS sample_has_sector, 0 AS lent FROM strata_picks UNION ALL SELECT *, NOT has_sector, 1 FROM strata_picks)) WHERE pick <= 2""",
    "strata_picks",
)
def q07(spark, d):
    return profile.quantile_sample(merge.latest_row(tp.panel(spark, d)), DEFAULT.quantiles, ["AF", "EU"])


@query("q08_sample_tag", "SELECT ein, fiscal_year, ein IN ('1', '5', '42', '77') AS is_shared_sample FROM panel", "panel")
def q08(spark, d):
    return tp.panel(spark, d).select("ein", "fiscal_year", F.col("ein").isin("1", "5", "42", "77").alias("is_shared_sample"))


# --- row metrics ----------------------------------------------------------------------------------------------------


def row_metric(name: str, sql: str, column, view: str = "metrics"):
    @query(name, f"SELECT ein, fiscal_year, {sql} AS value FROM {view}", view)
    def f(spark, d):
        return m.with_metrics(tp.panel(spark, d)).select("ein", "fiscal_year", column().alias("value"))


row_metric("m01_operating_margin", "round(operating_margin, 6)", lambda: r6("operating_margin"))
row_metric("m02_runway_proxy", "round(operating_runway_proxy_months, 6)", lambda: r6("operating_runway_proxy_months"))
row_metric("m03_diversification", "round(revenue_diversification_index, 6)", lambda: r6("revenue_diversification_index"))
_S = "coalesce(pct_contributions, 0) + coalesce(pct_program_revenue, 0) + coalesce(pct_investment_income, 0) + coalesce(pct_other_revenue, 0)"
row_metric(
    "m04_diversification_renormalised",
    f"round(CASE WHEN revenue_diversification_index IS NULL THEN NULL WHEN {_S} = 0 THEN 0 ELSE 1 - (1 - revenue_diversification_index) / (({_S}) * ({_S})) END, 6)",
    lambda: r6(m.diversification_renormalised()),
)
row_metric("m05_shock_absorption", "round(shock_absorption_months, 6)", lambda: r6("shock_absorption_months"))


@query(
    "m06_model_ratios",
    "SELECT ein, fiscal_year, round((coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0)) / nullif(total_expenses, 0), 6) AS cash_to_expenses, round(total_revenue / nullif(total_expenses, 0), 6) AS revenue_to_expenses, round(net_assets_eoy / nullif(total_expenses, 0), 6) AS net_assets_to_expenses FROM panel",
    "panel",
)
def m06(spark, d):
    e = F.col("total_expenses")
    return tp.panel(spark, d).select("ein", "fiscal_year", r6(F.try_divide(m.liquid(), e)).alias("cash_to_expenses"), r6(F.try_divide(F.col("total_revenue"), e)).alias("revenue_to_expenses"), r6(F.try_divide(F.col("net_assets_eoy"), e)).alias("net_assets_to_expenses"))


row_metric("m07_government_dependency", "round(CASE WHEN total_revenue > 0 THEN contributions_grants * 0.4 / total_revenue END, 6)", lambda: r6(F.when(F.col("total_revenue") > 0, F.col("contributions_grants") * 0.4 / F.col("total_revenue"))))
DEFICIT = "CASE WHEN total_expenses IS NULL OR total_expenses <= 0 OR total_expenses - coalesce(total_revenue, 0) <= 0 THEN 120.0 ELSE least(120.0, (coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0)) / ((total_expenses - coalesce(total_revenue, 0)) / 12)) END"
row_metric("m08_deficit_runway", f"round({DEFICIT}, 6)", lambda: r6(m.deficit_runway(F.col("total_revenue"), F.col("total_expenses"), m.liquid())))
_Z = [f"coalesce({s}, 0)" for s in STREAMS]
LARGEST = f"greatest({', '.join(_Z)})"
LARGEST_NAME = f"CASE WHEN {_Z[0]} = {LARGEST} THEN 'contributions' WHEN {_Z[1]} = {LARGEST} THEN 'program_revenue' WHEN {_Z[2]} = {LARGEST} THEN 'investment_income' ELSE 'other_revenue' END"


@query("m09_largest_source", f"SELECT ein, fiscal_year, {LARGEST_NAME} AS source, {LARGEST} AS amount, round({LARGEST} / nullif(total_revenue, 0), 6) AS share FROM panel", "panel")
def m09(spark, d):
    df = tp.panel(spark, d).withColumn("top", m.largest_source())
    return df.select("ein", "fiscal_year", F.col("top.name").alias("source"), F.col("top.amount").alias("amount"), r6(F.try_divide(F.col("top.amount"), F.col("total_revenue"))).alias("share"))


YIELD_SQL = "CASE WHEN net_assets_eoy IS NULL OR investment_income IS NULL OR net_assets_eoy <= 0 THEN 0.0 ELSE round(investment_income / net_assets_eoy * 100, 3) END"


def investment_yield():
    a, i = F.col("net_assets_eoy"), F.col("investment_income")
    return F.when(a.isNull() | i.isNull() | (a <= 0), F.lit(0.0)).otherwise(F.round(i / a * 100, 3))


row_metric("m10_investment_yield", YIELD_SQL, investment_yield)
COMPLETE_FIELDS = ("investment_income", "contributions_grants", "cash_non_interest_bearing", "other_revenue", "program_service_revenue")
COMPLETE_SQL = "round((" + " + ".join(f"CAST({f} IS NOT NULL AS INT)" for f in COMPLETE_FIELDS) + ") / 5.0 * 8, 3)"


def completeness(fields=COMPLETE_FIELDS):
    return F.round((len(fields) - merge.fewest_nulls(fields)) / float(len(fields)) * 8, 3)


row_metric("m11_completeness", COMPLETE_SQL, completeness)


@query(
    "m12_revenue_cagr",
    """SELECT ein, round(pow(max_by(total_revenue, fiscal_year) / min_by(total_revenue, fiscal_year), 1.0 / (max(fiscal_year) - min(fiscal_year))) - 1, 6) AS cagr FROM panel WHERE total_revenue > 0 GROUP BY ein HAVING max(fiscal_year) > min(fiscal_year)""",
    "panel",
)
def m12(spark, d):
    g = tp.panel(spark, d).where("total_revenue > 0").groupBy("ein").agg(F.max_by("total_revenue", "fiscal_year").alias("b"), F.min_by("total_revenue", "fiscal_year").alias("a"), (F.max("fiscal_year") - F.min("fiscal_year")).alias("n"))
    return g.where("n > 0").select("ein", r6(F.pow(F.col("b") / F.col("a"), 1.0 / F.col("n")) - 1).alias("cagr"))


@query(
    "m13_yield_opportunity",
    f"""SELECT ein, basis, CASE WHEN basis = 'unavailable' THEN NULL ELSE round(greatest(5 - y, 0) / 100 * amount, 2) END AS annual_amount, basis = 'net-assets' AS is_upper_bound FROM (
      SELECT ein, y, CASE WHEN liquid > 0 THEN liquid WHEN net_assets_eoy > 0 THEN net_assets_eoy END AS amount, CASE WHEN liquid > 0 THEN 'liquid-reserves' WHEN net_assets_eoy > 0 THEN 'net-assets' ELSE 'unavailable' END AS basis
      FROM (SELECT ein, net_assets_eoy, {YIELD_SQL} AS y, coalesce(cash_non_interest_bearing, 0) + coalesce(savings_temporary_investments, 0) AS liquid, row_number() OVER (PARTITION BY ein ORDER BY fiscal_year DESC) AS rn FROM panel) WHERE rn = 1)""",
    "panel",
)
def m13(spark, d):
    one = merge.latest_row(tp.panel(spark, d)).withColumns({"y": investment_yield(), "liquid": m.liquid()})
    return yield_opportunity(one).select("ein", "basis", "annual_amount", "is_upper_bound")


def yield_opportunity(df):
    """Yield short of 5 % on the liquid reserves, or on net assets as an upper bound where no reserves are known."""
    basis = F.when(F.col("liquid") > 0, "liquid-reserves").when(F.col("net_assets_eoy") > 0, "net-assets").otherwise("unavailable")
    amount = F.when(F.col("liquid") > 0, F.col("liquid")).when(F.col("net_assets_eoy") > 0, F.col("net_assets_eoy"))
    df = df.withColumns({"basis": basis, "annual_amount": F.round(F.greatest(5 - F.col("y"), F.lit(0.0)) / 100 * amount, 2)})
    return df.withColumn("is_upper_bound", F.col("basis") == "net-assets")
