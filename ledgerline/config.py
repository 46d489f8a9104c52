"""The rules of a panel analysis as data: column roles, bands, windows and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Labels and bounds of the size bands (lower bound inclusive, upper exclusive).
SIZE_BANDS = (("<500K", None, 500_000.0), ("500K-2M", 500_000.0, 2_000_000.0), ("2M-10M", 2_000_000.0, 10_000_000.0), (">10M", 10_000_000.0, None))
#: Persistence rules as (label, metrics in the top quartile, years).
LADDER = (("3-of-3_5-of-7", 3, 5), ("2-of-3_5-of-7", 2, 5))
#: Cohort levels, finest first, with their names.
COHORT_LEVELS = (
    ("ntee+size_bucket+state", ("ntee_major_category", "size_bucket", "state")),
    ("size_bucket+state+return_type", ("size_bucket", "state", "return_type")),
    ("size_bucket+state", ("size_bucket", "state")),
)
STREAMS = ("contributions_grants", "program_service_revenue", "investment_income", "other_revenue")
STREAM_NAMES = ("contributions", "program_revenue", "investment_income", "other_revenue")
SHARES = ("pct_contributions", "pct_program_revenue", "pct_investment_income", "pct_other_revenue")
METRICS = ("operating_margin", "operating_runway_proxy_months", "revenue_diversification_index")
GAPS = ("operating_margin_gap", "operating_runway_gap", "revenue_diversification_gap")
BENCHMARKS = ("benchmark_operating_margin_q75", "benchmark_operating_runway_q75", "benchmark_revenue_diversification_q75")
#: Labels of recommended actions, in order of precedence.
REVIEW, OPTIMISE, DIVERSIFY, STRENGTHEN = "Needs Data Diligence", "Underinvested Asset Base", "Revenue Concentration Risk", "Weak Financial Foundation"


@dataclass(frozen=True)
class PanelConfig:
    entity: str = "ein"
    year: str = "fiscal_year"
    period: str = "tax_period_end"
    states: tuple[str, ...] = ("AF", "AM", "AS", "EU", "MI")
    scoring_years: tuple[int, ...] = (2000, 2001)
    window: int = 7
    min_cohort: int = 10
    min_references: int = 5
    levels: tuple = COHORT_LEVELS
    ladder: tuple = LADDER
    bands: tuple = SIZE_BANDS
    quality_fields: tuple[str, ...] = ("total_revenue", "total_expenses", "net_assets_eoy", "cash_non_interest_bearing", "savings_temporary_investments")
    pre_years: tuple[int, int] = (1995, 1997)
    post_years: tuple[int, int] = (1998, 2001)
    min_history: int = 3
    train_until: int = 1998
    test_from: int = 1999
    quantiles: tuple[float, ...] = (0.33, 0.66)
    top: int = 3
    extra: dict = field(default_factory=dict)


DEFAULT = PanelConfig()
