"""Trend, recommended action, reasons and memo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.config import DIVERSIFY, GAPS, OPTIMISE, REVIEW, STRENGTHEN
from ledgerline.functions.text import fixed, number

#: Names of the rules that a label can cite.
REVIEW_RULES = ("review_insufficient_resilient_refs", "review_low_confidence", "review_acute_and_severe_25pct_stress", "review_structural_outlier")
OPTIMISE_RULES = ("amplify_margin_above_benchmark", "amplify_runway_above_benchmark", "amplify_diversification_above_benchmark", "amplify_no_severe_25pct_stress", "amplify_no_urgency")
DIVERSIFY_RULES = ("diversify_concentration_gap_below_neg_0_30", "diversify_margin_at_or_above_neg_0_30", "diversify_no_severe_25pct_stress", "diversify_no_urgency")
STRENGTHEN_RULES = ("stabilize_default_scoreable", ("stabilize_primary_constraint_low_margin", "stabilize_primary_constraint_low_runway", "stabilize_primary_constraint_high_concentration_in_volatile_source"))
CONCENTRATION_GAP = -0.3


def trend(scored: DataFrame, prior: int, current: int, tolerance: float = 0.1) -> DataFrame:
    """improving if the gap rose by no more than the tolerance since the prior year; unavailable if either is unknown."""
    before = scored.where(F.col("fiscal_year") == prior).select("ein", F.col("resilience_gap").alias("_before"), F.lit(current).alias("fiscal_year"))
    out = scored.join(before, ["ein", "fiscal_year"], "left")
    ok = F.col("resilience_gap") <= F.col("_before") + tolerance
    return out.withColumn("trend_direction", F.when(ok, "improving").when(~ok, "declining").otherwise("unavailable")).drop("_before")


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _parts():
    severe = _sure(F.col("stress_25pct_severity").isin("severe", "critical"))
    review = (
        _sure(F.col("benchmark_status") == "insufficient_resilient_refs"),
        _sure(F.col("checkpoint1_confidence_tier") == "Low"),
        _sure(F.col("urgency_severity") == "acute") & severe,
        _sure(F.col("resilience_gap") > 2.0),
    )
    calm = ~severe & _sure(F.col("urgency_severity") == "none")
    margin, runway, mix = map(F.col, GAPS)
    optimise = _sure((margin >= 0) & (runway >= 0) & (mix >= 0)) & calm
    diversify = _sure((mix <= CONCENTRATION_GAP) & (margin >= -0.3)) & calm
    return review, optimise, diversify


def label(df: DataFrame) -> DataFrame:
    """action_label and its rules, in order of precedence."""
    review, optimise, diversify = _parts()
    deep = review[0] | review[1] | review[2] | review[3]
    name = F.when(deep, REVIEW).when(optimise, OPTIMISE).when(diversify, DIVERSIFY).otherwise(STRENGTHEN)
    cited = F.filter(F.array(*[F.when(x, F.lit(n)) for x, n in zip(review, REVIEW_RULES)]), lambda x: x.isNotNull())
    least = F.array_min(F.filter(F.array(*[F.struct(F.col(g).alias("gap"), F.lit(i).alias("i"), F.lit(n).alias("rule")) for i, (g, n) in enumerate(zip(GAPS, STRENGTHEN_RULES[1]))]), lambda x: x["gap"].isNotNull()))
    plain = lambda names: F.array(*map(F.lit, names))
    weak = F.filter(F.array(F.lit(STRENGTHEN_RULES[0]), least["rule"]), lambda x: x.isNotNull())
    why = F.when(deep, cited).when(optimise, plain(OPTIMISE_RULES)).when(diversify, plain(DIVERSIFY_RULES)).otherwise(weak)
    return df.withColumns({"action_label": name, "action_label_rationale": why})


def corrupt(df: DataFrame) -> Column:
    """Rows with the last label and no gap at all: something upstream is broken."""
    return (F.col("action_label") == STRENGTHEN) & F.coalesce(*GAPS).isNull()


def gap_phrase(gap: Column) -> Column:
    return (
        F.when(gap.isNull(), "unavailable")
        .when(gap >= 0, "above peer benchmark")
        .when(gap >= -0.3, "near peer benchmark")
        .when(gap >= -1.0, "below peer benchmark")
        .otherwise("materially behind peer benchmark")
    )


def _constraint_words() -> Column:
    return F.coalesce(F.replace("recovery_analog_constraint", F.lit("_"), F.lit(" ")), F.lit("constraint"))


def memo(df: DataFrame) -> DataFrame:
    """memo_text: seven clauses in fixed order. The sentences are those of the memo contract."""
    c = F.col
    n = lambda x, k=2: number(c(x), k)
    snapshot = F.concat(F.coalesce(c("org_name"), F.lit("unknown")), F.lit(" ("), c("state"), F.lit(") FY"), c("fiscal_year").cast("string"), F.lit(", "), c("size_bucket"), F.lit(", revenue $"), F.format_number("total_revenue", 0), F.lit("."))
    cohort = F.concat(F.lit("Cohort: "), F.coalesce(c("ntee_major_category"), F.lit("unclassified")), F.lit(", "), c("cohort_size").cast("string"), F.lit(" orgs, benchmark rule "), c("rule"), F.lit("."))

    def versus(word: str, value: str, bench: str, gap: str, k: int) -> Column:
        return F.concat(F.lit(f"{word} "), n(value, k), F.lit(" vs "), n(bench, k), F.lit(" ("), gap_phrase(c(gap)), F.lit(")"))

    way = F.when(c("trend_direction") == "unavailable", "").otherwise(F.concat(F.lit(" Trend is "), c("trend_direction"), F.lit(".")))
    resilience = F.concat(
        F.lit("Resilience: "),
        versus("margin", "operating_margin", "benchmark_operating_margin_q75", GAPS[0], 2),
        F.lit("; "),
        versus("runway", "operating_runway_proxy_months", "benchmark_operating_runway_q75", GAPS[1], 1),
        F.lit("; "),
        versus("diversification", "revenue_diversification_index", "benchmark_revenue_diversification_q75", GAPS[2], 2),
        F.lit("."),
        way,
    )
    burn = F.when(c("stress_25pct_burn_months").isNull(), "no burn-month estimate").otherwise(F.concat(F.lit("burn months "), n("stress_25pct_burn_months", 1)))
    stress = F.when(c("stress_test_status") != "computed", "Stress test: unavailable due to missing raw inputs.").otherwise(
        F.concat(F.lit("Stress test: a 25% shock to the largest revenue source yields "), burn, F.lit(" with severity "), c("stress_25pct_severity"), F.lit("."))
    )
    e = F.try_element_at("recovery_analog_evidence", F.lit(1))
    analog = F.coalesce(
        F.concat(e["org_name"], F.lit(" ("), e["state"], F.lit(") recovered from a similar "), _constraint_words(), F.lit(" position between "), e["pre_window_year"].cast("string"), F.lit(" and "), e["post_recovery_year"].cast("string"), F.lit(", improving "), e["matched_metric_name"], F.lit(" from "), number(e["matched_metric_pre_value"]), F.lit(" to "), number(e["matched_metric_post_value"]), F.lit(".")),
        F.lit("Recovery analog evidence is unavailable."),
    )
    three = F.concat(F.lit("argin gap "), n(GAPS[0]), F.lit(", runway gap "), n(GAPS[1]), F.lit(", and diversification gap "), n(GAPS[2]))
    reason = (
        F.when(c("action_label") == OPTIMISE, F.concat(F.lit("M"), three, F.lit(" are all above benchmark, with 25% stress severity "), F.coalesce(c("stress_25pct_severity"), F.lit("None")), F.lit(" and urgency "), c("urgency_severity"), F.lit(".")))
        .when(c("action_label") == DIVERSIFY, F.concat(F.lit("Diversification gap "), n(GAPS[2]), F.lit(" is materially below benchmark while margin gap "), n(GAPS[0]), F.lit(" remains above the -0.30 floor and 25% stress severity is "), F.coalesce(c("stress_25pct_severity"), F.lit("None")), F.lit(".")))
        .when(c("action_label") == REVIEW, F.concat(F.lit("This row triggered "), F.array_join("action_label_rationale", ", "), F.lit(", with benchmark status "), c("benchmark_status"), F.lit(", confidence "), c("checkpoint1_confidence_tier"), F.lit(", and resilience gap "), n("resilience_gap"), F.lit(".")))
        .otherwise(F.concat(F.lit("Primary constraint is "), _constraint_words(), F.lit(" with m"), three, F.lit(".")))
    )
    low = c("checkpoint1_confidence_tier") == "Low"
    note = (
        F.when(low & (c("urgency_severity") == "acute"), "Confidence: Low. The data points to possible imminent distress; verify current filings before any capital decision.")
        .when(low, "Confidence: Low. The data does not support a specific recommendation; review the row directly before action.")
        .when(c("checkpoint1_confidence_tier") == "Medium", "Confidence: Medium. Moderate confidence due to filing or cohort limitations.")
        .otherwise("Confidence: High.")
    )
    action = F.concat(F.lit("Recommended action: "), c("action_label"), F.lit(". "), reason)
    return df.withColumn("memo_text", F.concat_ws(" ", snapshot, cohort, resilience, stress, analog, action, note))


#: The contract's words for review rules in the second form of the memo.
REVIEW_WORDS = dict(zip(REVIEW_RULES, ("insufficient resilient peer references for benchmarking", "low data confidence in the underlying filings", "acute urgency combined with severe stress-test exposure")))


def memo_in_sentences(df: DataFrame) -> DataFrame:
    """memo_text in the contract's second form (its sentences are fixed values): snapshot, cohort, three gaps, stress, analog,
    action with its reason, confidence."""
    c, lit = F.col, F.lit
    v = lambda x, k=2: number(c(x), k, "N/A")
    e = F.try_element_at("recovery_analog_evidence", F.lit(1))
    plain = lambda x: F.when(x == "low_margin", "low operating margin").when(x == "low_runway", "low operating runway").when(x == "high_concentration_in_volatile_source", "high revenue concentration").otherwise(F.coalesce(x, lit("unspecified constraint")))
    revenue = F.when(c("total_revenue").isNull(), "N/A").when(F.abs("total_revenue") >= 1e6, F.concat(lit("$"), F.format_number(c("total_revenue") / 1e6, 1), lit("M"))).when(F.abs("total_revenue") >= 1e3, F.concat(lit("$"), F.format_number(c("total_revenue") / 1e3, 0), lit("K"))).otherwise(F.concat(lit("$"), F.format_number("total_revenue", 0)))
    snapshot = F.concat(F.coalesce(c("org_name"), lit("unknown")), lit(" ("), c("state"), lit(", FY"), c("fiscal_year").cast("string"), lit(", "), F.coalesce(c("size_bucket"), lit("N/A")), lit(", revenue "), revenue, lit(")."))
    sector = F.when(c("ntee_major_category").isNull(), "unclassified sector").otherwise(F.concat(lit("NTEE category "), c("ntee_major_category")))
    cohort = F.concat(lit("Benchmarked within "), sector, lit(", cohort of "), c("cohort_size").cast("string"), lit(" peers, rule: "), F.coalesce(c("rule"), lit("N/A")), lit("."))
    versus = lambda name, value, bench, gap, unit="": F.concat(lit(f"{name} of "), v(value), lit(f"{unit} versus benchmark "), v(bench), lit(f"{unit} ("), gap_phrase(c(gap)), lit(")."))
    three = F.concat_ws(
        " ",
        versus("Operating margin", "operating_margin", "benchmark_operating_margin_q75", GAPS[0]),
        versus("Operating runway", "operating_runway_proxy_months", "benchmark_operating_runway_q75", GAPS[1], " months"),
        versus("Revenue diversification", "revenue_diversification_index", "benchmark_revenue_diversification_q75", GAPS[2]),
    )
    burn = F.coalesce(F.concat(lit(" with "), fixed(c("stress_25pct_burn_months"), 1), lit(" months of burn runway")), lit(""))
    stress = F.when(c("stress_test_status") == "computed", F.concat(lit("Under a 25% largest-source shock, severity is "), c("stress_25pct_severity"), F.when(c("stress_25pct_burn_months").isNull(), "").otherwise(burn), lit("."))).otherwise("Stress-test scenario unavailable due to missing raw inputs.")
    years = F.concat(lit("between "), e["pre_window_year"].cast("string"), lit(" and "), e["post_recovery_year"].cast("string"))
    analog = F.coalesce(
        F.concat(e["org_name"], lit(" ("), e["state"], lit(") recovered from a similar "), plain(c("recovery_analog_constraint")), lit(" position "), years, lit(", improving "), e["matched_metric_name"], lit(" from "), number(e["matched_metric_pre_value"]), lit(" to "), number(e["matched_metric_post_value"]), lit(".")),
        lit("No recovery analog evidence is available for this organization."),
    )
    outlier = F.concat(lit("resilience gap of "), v("resilience_gap"), lit(" exceeds the structural outlier threshold of 2.0"))
    said = lambda r: reduce(lambda a, k: F.when(r == k, REVIEW_WORDS[k]).otherwise(a), REVIEW_WORDS, F.when(r == REVIEW_RULES[3], outlier).otherwise(r))
    why = (
        F.when(c("action_label") == REVIEW, F.when(F.size("action_label_rationale") == 0, "This organization requires deeper diligence before any recommendation.").otherwise(F.concat(lit("This is driven by "), F.array_join(F.transform("action_label_rationale", said), "; "), lit("."))))
        .when(c("action_label") == OPTIMISE, "All three resilience metrics are at or above cohort benchmarks, with no severe stress-test exposure and no urgency flag.")
        .when(c("action_label") == DIVERSIFY, F.concat(lit("Revenue diversification gap of "), v(GAPS[2]), lit(" indicates elevated concentration risk, while operating margin remains adequate for targeted diversification.")))
        .otherwise(F.concat(lit("The primary constraint is "), plain(c("recovery_analog_constraint")), lit(", which should be addressed before additional capital deployment.")))
    )
    tier = c("checkpoint1_confidence_tier")
    sure = (
        F.when((tier == "Low") & (c("urgency_severity") == "acute"), "Data confidence is insufficient to support a specific action recommendation. The available data suggests potential imminent distress, but current filings should be verified directly before any capital decision.")
        .when(tier == "Low", "Data confidence is insufficient to support a specific action recommendation and the row should be reviewed directly before action.")
        .when(tier == "Medium", "Data confidence is moderate; additional verification may strengthen this assessment.")
        .when(tier == "High", "Data confidence is high.")
    )
    return df.withColumn("memo_text", F.concat_ws(" ", snapshot, cohort, three, stress, analog, F.concat(lit("Recommended action: "), c("action_label"), lit(".")), why, sure))


def words(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def _position() -> Column:
    return F.when(F.col("resilience_gap").isNull(), "unavailable").when(F.col("resilience_gap") <= 0, "at or above peers").otherwise("below peers")


def portfolio_row(df: DataFrame) -> DataFrame:
    """The nine columns of a portfolio view."""
    c = F.col
    mix = F.concat(c("largest_revenue_source"), F.lit(" "), fixed(c("largest_revenue_source_pct") * 100, 0), F.lit("%"))
    return df.select(
        "ein", F.coalesce("org_name", F.lit("unknown")).alias("organization_name"), c("cohort_key").alias("peer_cohort"), "checkpoint1_confidence_tier", _position().alias("benchmark_position"),
        "resilience_gap", F.coalesce(mix, F.lit("unavailable")).alias("funding_concentration_profile"), "action_label", "urgency_flag",
    )


def memo_row(df: DataFrame) -> DataFrame:
    """The thirteen columns of a memo view."""
    c = F.col
    mix = F.concat(c("largest_revenue_source"), F.lit(" "), fixed(c("largest_revenue_source_pct") * 100, 0), F.lit("%"))
    return df.select(
        F.coalesce("org_name", F.lit("unknown")).alias("organization_name"), c("cohort_key").alias("peer_cohort"), c("checkpoint1_confidence_tier").alias("confidence_level"), _position().alias("benchmark_position_vs_peers"),
        "resilience_gap", c("trend_direction").alias("trend_7_year"), F.coalesce("recovery_analog_constraint", F.lit("none")).alias("biggest_financial_constraint"), F.coalesce(mix, F.lit("unavailable")).alias("funding_concentration_profile"),
        "shock_absorption_months", F.coalesce("stress_25pct_severity", F.lit("unavailable")).alias("stress_test_scenario"), F.array_join("recovery_analog_eins", ",").alias("recovery_analogs"),
        c("action_label").alias("final_recommendation"), c("memo_text").alias("plain_english_why"),
    )
