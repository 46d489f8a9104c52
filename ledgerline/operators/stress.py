"""Revenue shocks, severity bands and urgency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.metrics import deficit_runway, largest_source, liquid

SCENARIOS = (("25pct", 0.25), ("50pct", 0.5))


def shocks(df: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Largest source and, for each scenario, revenue after the shock, months of reserves and severity. All null unless
    revenue is positive and expenses, net assets, cash and savings are known."""
    rev, exp = F.col("total_revenue"), F.col("total_expenses")
    cash = F.col("cash_non_interest_bearing") + F.col("savings_temporary_investments")
    ok = F.coalesce((rev > 0) & exp.isNotNull() & F.col("net_assets_eoy").isNotNull() & cash.isNotNull(), F.lit(False))
    out = df.withColumns({"_top": largest_source(), "_ok": ok})
    out = out.withColumns({"largest_revenue_source": F.when(F.col("_ok"), F.col("_top.name")), "largest_revenue_source_pct": F.when(F.col("_ok"), F.try_divide(F.col("_top.amount"), rev))})
    for name, size in scenarios:
        after = rev - F.col("largest_revenue_source_pct") * rev * size
        monthly = (exp - after) / 12
        burn = F.when(F.col("_ok") & (after < exp) & (monthly > 0), cash / monthly)
        out = out.withColumns({f"stress_{name}_post_shock_revenue": F.when(F.col("_ok"), after), f"stress_{name}_burn_months": burn, f"stress_{name}_severity": F.when(F.col("_ok"), severity(after, exp, burn))})
    return out.withColumn("stress_test_status", F.when(F.col("_ok"), "computed").otherwise("not_applicable")).drop("_top", "_ok")


def severity(after: Column, expenses: Column, burn: Column) -> Column:
    return (
        F.when((F.col("net_assets_eoy") < 0) | (after < 0), "critical")
        .when(after >= expenses, "none")
        .when(burn < 1, "critical")
        .when(burn <= 6, "severe")
        .when(burn <= 24, "moderate")
        .otherwise("mild")
    )


def deficit_stress(df: DataFrame) -> DataFrame:
    """Deficit runway now and after shocks of 25 and 50 % of the largest source, with severity names."""
    rev, exp = F.coalesce("total_revenue", F.lit(0.0)), F.coalesce("total_expenses", F.lit(0.0))
    top = largest_source()
    band = lambda x: F.when(x < 1, "Severe").when(x < 3, "Moderate").when(x < 6, "Mild").otherwise("None")
    run = lambda s: deficit_runway(rev - top["amount"] * s, exp, liquid())
    share = F.when(rev > 0, F.least(F.greatest(top["amount"] / rev * 100, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)
    out = df.withColumns({"burn0": run(0.0), "burn25": run(0.25), "burn50": run(0.5), "largest_pct": share, "largest_name": top["name"]})
    return out.withColumns({"severity25": band(F.col("burn25")), "severity50": band(F.col("burn50"))})


def interpolated(shock: Column, at0: Column, at25: Column, at50: Column) -> Column:
    """Runway at any shock of 0 to 75 %, piecewise linear; the value at 75 % goes on as from 25 to 50."""
    at75 = F.greatest(F.lit(0.0), at50 - F.greatest(F.lit(0.0), at25 - at50))
    return (
        F.when(shock <= 25, at0 + (at25 - at0) * shock / 25)
        .when(shock <= 50, at25 + (at50 - at25) * (shock - 25) / 25)
        .otherwise(at50 + (at75 - at50) * (shock - 50) / 25)
    )


def urgency(df: DataFrame) -> DataFrame:
    """Flag: under three months of reserves and a negative margin; acute: under one and below -10 %."""
    s, m = F.col("shock_absorption_months"), F.col("operating_margin")
    scoreable = F.lit(True) if "benchmark_status" not in df.columns else F.coalesce(F.col("benchmark_status") != "not_scoreable", F.lit(True))
    urgent = F.coalesce((s < 3) & (m < 0) & scoreable, F.lit(False))
    acute = urgent & F.coalesce((s < 1) & (m < -0.1), F.lit(False))
    return df.withColumns(
        {
            "urgency_flag": urgent,
            "urgency_severity": F.when(acute, "acute").when(urgent, "flagged").otherwise("none"),
            "urgency_reason": F.when(acute, "negative_margin_and_lt1m_shock_absorption_and_margin_below_neg10pct").when(urgent, "negative_margin_and_lt3m_shock_absorption").otherwise("none"),
        }
    )
